import random
from dataclasses import replace

from pyspark.sql import functions as F

from gleanery.config import DEFAULT
from gleanery.functions import text
from gleanery.operators import dedup, rules, scoring, views

col, lit = F.col, F.lit


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def folded(s):
    return text.fold(lit(s))


def test_relevance(spark):
    ok = lambda t, d="", local=False: one(spark, rules.relevance(folded(t), folded(d), lit(local)))
    assert ok("Junior Frontend Developer").ok and not ok("Sales Engineer").ok
    assert not ok("PHP Developer").ok and ok("PHP Developer", local=True).ok
    assert ok("Graduate Engineer", "We use React").ok and not ok("Graduate Engineer", "We use Cobol").ok
    assert ok("Sales Lead").reason == "Title matches excluded term 'sales'"


def test_required_years(spark):
    years = lambda d: one(spark, rules.required_years(folded(d)))
    assert years("3+ years of experience. 5 years preferred experience.") == 3
    assert years("experience of 1-2 years") == 1 and years("25 years experience") is None
    assert years("founded 10 years ago") is None and years("18 years old with experience") is None


def test_seniority(spark):
    s = lambda t, d="": one(spark, rules.seniority(folded(t), folded(d)))
    assert s("Senior Engineer").reasons == ["Senior-level title ('senior')"] and not s("Junior Lead Trainee").blocked
    assert s("Engineer", "Requires 4 years of experience").reasons == ["Requires 4+ years of experience (limit 2)"]


def eligible(spark, location=None, restrictions=None, mode="remote", description=""):
    regions = lit(None).cast("array<string>") if restrictions is None else F.array(*map(lit, restrictions))
    r = one(spark, rules.eligibility(lit(location).cast("string"), folded(location or ""), regions, lit(mode), lit(description), folded(description)))
    return r.status, r.explicit


def test_eligibility(spark):
    cases = [
        (dict(description="We cannot hire in Nepal."), ("not_eligible", True)),
        (dict(location="Kathmandu", mode="onsite"), ("eligible", True)),
        (dict(location="Berlin", mode="hybrid"), ("not_eligible", True)),
        (dict(restrictions=["NP"]), ("eligible", True)),
        (dict(restrictions=["Worldwide"]), ("eligible", True)),
        (dict(restrictions=["South Asia."]), ("likely_eligible", False)),
        (dict(restrictions=["USA"]), ("not_eligible", True)),
        (dict(restrictions=[" "], location="APAC"), ("likely_eligible", False)),
        (dict(location="Remote, Europe"), ("not_eligible", True)),
        (dict(description="US only"), ("not_eligible", True)),
        (dict(description="contact us only by mail"), ("unclear", False)),
        (dict(description="Work from anywhere, must be based in Canada"), ("unclear", False)),
        (dict(description="worldwide"), ("eligible", False)),
        (dict(description="team across asia"), ("likely_eligible", False)),
        (dict(), ("unclear", False)),
    ]
    for arguments, want in cases:
        assert eligible(spark, **arguments) == want, arguments


def test_merged_eligibility(spark):
    merge = lambda a, b: one(spark, rules.merged_eligibility(lit(a), lit("r"), lit(b), lit("a")))
    assert merge("not_eligible", "eligible").status == "unclear" and merge("not_eligible", "unclear") == ("not_eligible", "r")
    assert merge("unclear", "likely_eligible") == ("likely_eligible", "a") and merge("eligible", "likely_eligible") == ("likely_eligible", "a")
    assert merge("not_eligible", "not_eligible").evidence == "r | AI: a" and merge("eligible", "unclear") == ("eligible", "r")


def test_apply_method(spark):
    how = lambda url=None, mail=None, d="": tuple(one(spark, rules.apply_method(lit(url).cast("string"), lit(mail).cast("string"), lit(d))))
    assert how(mail="a@b.co") == ("email", "a@b.co") and how("mailto:x@y.io?subject=1") == ("email", "x@y.io")
    assert how("https://boards.greenhouse.io/a/1")[0] == "ats_form" and how("https://np.linkedin.com/x")[0] == "login_required" and how("https://acme.io")[0] == "external_form"
    assert how(d="Write to privacy@a.io.\nSend your CV to jobs@a.io or noreply@a.io") == ("email", "jobs@a.io") and how(d="mail me@a.io") == ("unclear", None)


def legit(spark, **given):
    none = {k: lit(None).cast("string") for k in ("source", "source_url", "apply_url", "apply_email", "company", "website")} | {"pay_min": lit(None).cast("double"), "pay_max": lit(None).cast("double"), "domain_age": lit(None).cast("int"), "description": lit("x" * 300)}
    args = none | {k: lit(v) for k, v in given.items()}
    return one(spark, rules.legitimacy(text=text.fold(F.concat_ws("\n", lit("t"), args["description"])), **args))


def test_legitimacy(spark):
    assert legit(spark, company="A", source="remotive", source_url="https://jobs.lever.co/a", website="https://a.io", apply_url="https://jobs.a.io").score == 100
    scam = legit(spark, company="A", description="Pay a registration fee and send money " + "x" * 300)
    assert (scam.score, scam.verdict, [f.code for f in scam.flags]) == (0, "suspicious", ["payment_request"] * 2)
    assert legit(spark, company="A", domain_age=10).verdict == "suspicious" and legit(spark, company="A", domain_age=100).score == 45
    assert legit(spark, apply_email="x@gmail.com", description="short").score == 60 - 15 - 10 - 8


def test_merged_legitimacy(spark):
    own = rules.legitimacy(text=lit("t"), description=lit("x" * 300), **{k: lit(None).cast("string") for k in ("source", "source_url", "apply_url", "apply_email", "website")}, company=lit("A"), pay_min=lit(None).cast("double"), pay_max=lit(None).cast("double"), domain_age=lit(None).cast("int"))
    r = one(spark, rules.merged_legitimacy(own, lit("legitimate"), F.array(lit("thin"))))
    assert (r.score, r.verdict, r.flags[-1].code) == (68, "uncertain", "ai_concern")
    assert one(spark, rules.merged_legitimacy(own, lit("suspicious"), F.array().cast("array<string>"))).verdict == "suspicious"


def test_match_score_and_pay(spark):
    parts = {n: (lit(v), lit("why")) for n, v in {"skills_match": 90.0, "experience_fit": 80.0, "role_fit": 150.0, "eligibility": 100.0, "compensation": 60.0}.items()}
    r = one(spark, scoring.match_score(parts, DEFAULT.weights))
    assert r.score == round(31.5 + 16 + 15 + 10 + 6) and r.breakdown["growth_value"].score == 0 and r.breakdown["role_fit"].score == 100
    pay = lambda low, high, kind="full_time": one(spark, scoring.compensation(lit(low).cast("double"), lit(high).cast("double"), lit(kind)))
    assert [pay(None, None).score, pay(50000, None).score, pay(1000, 45000).score, pay(25000, None).score, pay(25000, None, "internship").score, pay(100, None).score] == [60, 100, 85, 55, 75, 25]
    assert pay(50000, None).reasoning == "Pays at least NPR 50,000/month"


def test_decide(spark):
    def decide(cfg=DEFAULT, **given):
        args = {"score": 90, "eligibility": "eligible", "legitimacy": "legitimate", "mode": "remote", "method": "email", "email": "a@b.c"} | given
        blocked = F.array(*map(lit, args.pop("blocked", []))) if args.get("blocked") else F.array().cast("array<string>")
        args.pop("blocked", None)
        r = one(spark, scoring.decide(blocked_by=blocked, cfg=cfg, **{k: lit(v) for k, v in args.items()}))
        return r.recommendation, r.review_status

    assert decide() == ("auto_apply_candidate", "auto_apply_disabled")
    assert decide(replace(DEFAULT, auto_apply_enabled=True)) == ("auto_apply_candidate", "pending_approval")
    assert decide(method="ats_form") == ("manual_apply", "ready_to_apply") and decide(mode="hybrid") == ("approval_required", "pending_approval")
    assert decide(score=75) == ("approval_required", "pending_approval") and decide(score=50) == ("ignore", "none") and decide(blocked=["no"]) == ("blocked", "none")


def sequential(rows, least=90.0, limit=dedup.LEADERS):
    """Each posting against the originals of its company so far."""
    leaders, out = {}, {}
    for i, company, title, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        mine = leaders.setdefault(company, [])[:limit]
        same = next((x for x, t in mine if t == title), None)
        scored = [(dedup.similarity(title, t), x) for x, t in mine]
        best = max(scored, key=lambda s: s[0], default=(0, None))
        out[i] = same if same is not None else best[1] if best[0] >= least else None
        if out[i] is None:
            leaders[company].append((i, title))
    return out


def test_near_duplicates(spark):
    rng = random.Random(8)
    words = ["frontend", "developer", "developers", "react", "senior", "engineer", "engineers", "qa", "lead"]
    rows = [(i, rng.choice(["a", "b", "hot", "hot", "hot"]), " ".join(rng.sample(words, rng.randrange(2, 5))), 1000 + rng.randrange(500)) for i in range(500)]
    titles = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(230)]
    rows += [(2000 + i, "many", t, 1100 + i) for i, t in enumerate(titles)] + [(3000 + i, "many", t, 1400 + i) for i, t in enumerate(titles[::5])]
    extra = [(900, "", "x", 1100), (901, "a", None, 1100), (902, "a", rows[0][2], 10)]
    df = spark.createDataFrame(rows + extra, "id long, company_norm string, title_norm string, first_seen_hour long")
    got = {r.id: r.duplicate_of for r in dedup.near_duplicates(df, 1600).collect()}
    assert got == sequential(rows) | {900: None, 901: None, 902: None}
    assert dedup.near_duplicates(df.limit(0), 1600).count() == 0


def test_link_outcomes(spark):
    links = [(1, "https://jobs.lever.co/ab/1"), (2, "https://jobs.lever.co/ab/2"), (3, "https://jobs.lever.co/known"), (4, "https://www.facebook.com/x"), (5, "https://x.io/a.pdf"), (6, "ftp://x"), (7, "https://x.io/p?utm_source=1"), (8, "http://www.x.io/p/"), (9, "https://x.io/seen"), (10, None), (11, "https://x.io/q")]
    df = spark.createDataFrame([(i, u, 1) for i, u in links], "id long, url string, run_id long")
    boards = spark.createDataFrame([("lever", "known")], "provider string, slug string")
    known = spark.createDataFrame([("https://x.io/seen",)], "u string").select(F.sha2("u", 256).alias("url_hash"))
    got = {r.id: r.outcome for r in dedup.link_outcomes(df, boards, known, replace(DEFAULT, max_pages_per_run=1)).collect()}
    assert got == {1: "board_new", 2: "board_known", 3: "board_known", 4: "lead", 5: "invalid", 6: "invalid", 7: "page_queued", 8: "url_known", 9: "url_known", 10: "invalid", 11: "page_deferred"}


def test_auto_apply_blockers(spark):
    row = spark.range(1).select(lit("auto_apply_candidate").alias("recommendation"), lit(90).alias("match_score"), lit("eligible").alias("eligibility"), lit("legitimate").alias("legitimacy_verdict"), lit("email").alias("apply_method"), lit("a@b.c").alias("apply_email"), lit(True).alias("materials_verified"), lit(None).cast("long").alias("prior_application"))
    assert row.select(views.auto_apply_blockers(replace(DEFAULT, auto_apply_enabled=True), submitter=True)).first()[0] == []
    assert len(row.select(views.auto_apply_blockers()).first()[0]) == 2


def test_merged_ways_to_apply_and_seniority(spark):
    """An address of the analysts counts only if the posting has it; their years only without a reason of the rules."""
    rows = [
        ("unclear", None, "email", "Jobs@X.example", "write to jobs@x.example now", [], 3), ("unclear", None, "email", "made@up.example", "write to us", [], 2), ("unclear", None, "ats_form", "a@b.co", "a@b.co", ["Senior"], 9),
        ("email", "own@x.co", "ats_form", "a@b.co", "a@b.co", [], None), ("unclear", None, "unclear", None, None, [], 3), ("unclear", None, None, None, None, [], None), ("unclear", "k@l.mn", "email", "", "", [], 1), ("unclear", None, "email", None, "x", [], 1),
    ]
    df = spark.createDataFrame(rows, "m string, e string, method string, email string, d string, own array<string>, years int")
    from pyspark.sql import functions as F

    out = df.select(rules.merged_apply(F.struct(F.col("m").alias("method"), F.col("e").alias("email")), F.col("method"), F.col("email"), F.col("d")).alias("a"), rules.merged_seniority(F.col("own"), F.col("years")).alias("s")).collect()
    assert [tuple(r.a) for r in out] == [("email", "Jobs@X.example"), ("unclear", None), ("ats_form", None), ("email", "own@x.co"), ("unclear", None), ("unclear", None), ("unclear", "k@l.mn"), ("unclear", None)]
    assert [r.s for r in out] == [["Requires 3+ years of experience (limit 2)"], [], ["Senior"], [], ["Requires 3+ years of experience (limit 2)"], [], [], []]


def test_work_mode_is_read_from_the_start_of_the_text_before_folding(spark, tmp_path):
    from gleanery import registry

    rows = [(3, "世" * 100 + " " * 1900 + "remote work", "en", "a", 2011), (14, "世" * 100 + " " * 1800 + "remote work", "en", "a", 1911)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.id: r.mode for r in registry.queries()["work_classes"](spark, str(tmp_path)).collect()} == {3: "unknown", 14: "remote"}
