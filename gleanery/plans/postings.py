"""The posting pipeline as one plan: forms, rules, scores, verdicts, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.config import DEFAULT, Config
from gleanery.functions import classify, money, text
from gleanery.operators import joins, rules, scoring

col = F.col


def at(hour: str):
    return F.timestamp_seconds(col(hour) * 3600)


def folded(postings: DataFrame) -> DataFrame:
    """Postings with folded texts as columns, once for all rules."""
    out = postings.withColumns({f"{n}_folded": text.fold(col(c)) for n, c in (("title", "title"), ("description", "description"), ("location", "location_text"), ("company", "company_name"))})
    return out.withColumns({"whole_folded": F.concat_ws("\n", "title_folded", "description_folded"), "start_folded": F.concat_ws("\n", "title_folded", F.substring("description_folded", 1, 6000))})


def formed(postings: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Folded postings with their normal forms and monthly pay."""
    out = folded(postings).withColumns({"company_norm": text.company_form(col("company_folded")), "title_norm": text.title_form(col("title_folded")), "pay": money.salary(col("pay_text"), cfg.base_currency)})
    monthly = lambda bound: money.monthly(col(f"pay.{bound}"), col("pay.currency"), col("pay.period"), cfg.fx)
    return out.withColumns({
        "fingerprint": text.fingerprint(col("company_norm"), col("title_norm")),
        "pay_min": monthly("min"), "pay_max": monthly("max"),
        "employment_type": classify.employment(col("title_folded")),
        "location_restrictions": F.split("restrictions", ";"),
    })


def ruled(postings: DataFrame, now_hour: int, cfg: Config = DEFAULT) -> DataFrame:
    """Formed postings with a column for each rule. No shuffle: projections only."""
    t, d, place, source = col("title_folded"), col("description_folded"), col("location_folded"), col("source")
    local = rules.home_local(place, source, cfg)
    now = F.timestamp_seconds(F.lit(now_hour * 3600))
    out = postings.withColumns({
        "stale": rules.stale(at("posted_hour"), at("expires_hour"), now, cfg),
        "relevant": rules.relevance(t, d, local, cfg),
        "senior": rules.seniority(t, d, cfg),
        "eligible": rules.eligibility(col("location_text"), place, col("location_restrictions"), col("remote_type"), col("description"), d, cfg),
        "apply": rules.apply_method(col("apply_url"), col("apply_email"), col("description"), cfg),
    })
    hinted = rules.hint_blocks(col("seniority_hint"), t)
    senior = F.struct(
        (col("senior.blocked") | hinted).alias("blocked"),
        F.array_compact(F.concat(col("senior.reasons"), F.array(F.when(hinted, F.concat(F.lit("Listed seniority level: "), col("seniority_hint")))))).alias("reasons"),
        col("senior.required_years").alias("required_years"), col("senior.junior_title").alias("junior_title"),
    )
    legit = rules.legitimacy(
        cfg, text=col("whole_folded"), description=col("description"), source=source, source_url=F.lit(None).cast("string"), apply_url=col("apply_url"), apply_email=col("apply_email"),
        company=col("company_name"), website=col("company_website"), pay_min=col("pay_min"), pay_max=col("pay_max"), domain_age=F.lit(None).cast("int"))
    queue = rules.queue_score(cfg, t=t, d=d, text=col("start_folded"), place=place, mode=col("remote_type"), source=source, pay_min=col("pay_min"), pay_max=col("pay_max"), eligible=col("eligible.status"))
    return out.withColumns({"senior": senior, "legit": legit, "queue": queue})


def open_rows(postings: DataFrame, now_hour: int, cfg: Config = DEFAULT) -> DataFrame:
    """Formed postings that pass the first two stages, staleness and relevance. Both are cheap, and stop most rows
    before the other rules, the joins and the scores see them."""
    fresh = rules.stale(at("posted_hour"), at("expires_hour"), F.timestamp_seconds(F.lit(now_hour * 3600)), cfg).isNull()
    local = rules.home_local(col("location_folded"), col("source"), cfg)
    return postings.where(fresh & rules.relevance(col("title_folded"), col("description_folded"), local, cfg)["ok"])


def first_stopped(postings: DataFrame, now_hour: int, cfg: Config = DEFAULT) -> DataFrame:
    """Formed postings that the first two stages stop, with `stop` as `staged` gives it: no later rule can change it."""
    local = rules.home_local(col("location_folded"), col("source"), cfg)
    stale = rules.stale(at("posted_hour"), at("expires_hour"), F.timestamp_seconds(F.lit(now_hour * 3600)), cfg)
    rows = postings.withColumns({"stale": stale, "relevant": rules.relevance(col("title_folded"), col("description_folded"), local, cfg)})
    return rows.withColumn("stop", rules.first_stops(col("stale"), col("relevant"))).where("stop is not null")


def staged(postings: DataFrame, applications: DataFrame, now_hour: int, cfg: Config = DEFAULT) -> DataFrame:
    """Ruled postings with `stop`: where the chain of rules ends."""
    prior = joins.prior_applications(postings, applications, now_hour, cfg.duplicate_window_days, cfg.duplicate_title_similarity)
    out = ruled(postings, now_hour, cfg).join(prior.withColumnRenamed("application_id", "prior_application"), "id", "left")
    return out.withColumn("stop", rules.stage(cfg, stale=col("stale"), relevant=col("relevant"), senior=col("senior"), eligible=col("eligible"), legit=col("legit"), prior_application=col("prior_application")))


def decided(postings: DataFrame, analysis: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Staged postings that passed, merged with the analysts' verdicts: score, blockers, decision.

    analysis: id, four component scores (skills_match, experience_fit, role_fit, growth_value), is_real,
    senior_mismatch, required_years, eligibility_verdict, eligibility_evidence, legitimacy_verdict, concerns,
    remote_verdict, employment_verdict, application_method, application_email.

    Where the rules found no way to apply, the analysts' holds; but an address only if it stands in the posting. Their
    years count where the rules found no sign of seniority. A posting whose mode they tell is on site at home if its
    place is."""
    rows = postings.where(col("stop.stop_stage") == "passed").join(analysis, "id")
    rows = rows.withColumns({
        "mode": F.when((col("remote_type") == "unknown") | col("remote_type").isNull(), F.coalesce("remote_verdict", F.lit("unknown"))).otherwise(col("remote_type")),
        "kind": F.when(col("employment_type") == "unspecified", F.coalesce("employment_verdict", F.lit("unspecified"))).otherwise(col("employment_type")),
        "merged": rules.merged_eligibility(col("eligible.status"), col("eligible.evidence"), col("eligibility_verdict"), col("eligibility_evidence")),
        "legit": rules.merged_legitimacy(col("legit"), col("legitimacy_verdict"), col("concerns")),
        "apply": rules.merged_apply(col("apply"), col("application_method"), col("application_email"), col("description")),
        "seniority_reasons": rules.merged_seniority(col("senior.reasons"), col("required_years"), cfg),
    })
    at_home = col("mode").isin("onsite", "hybrid") & text.has_any(col("location_folded"), cfg.home_places[:5])
    pay = scoring.compensation(col("pay_min"), col("pay_max"), col("kind"), cfg)
    fit = F.coalesce(*[F.when(col("merged.status") == k, F.lit(v)) for k, v in scoring.ELIGIBILITY_POINTS.items()], F.lit(50))
    none = F.lit("")
    parts = {n: (col(n), none) for n in ("skills_match", "experience_fit", "role_fit", "growth_value")} | {"eligibility": (fit, col("merged.evidence")), "compensation": (pay["score"], pay["reasoning"])}
    rows = rows.withColumn("match", scoring.match_score(parts, cfg.weights))
    blocked = scoring.blockers(
        real=col("is_real"), seniority_reasons=col("seniority_reasons"), senior_mismatch=col("senior_mismatch"), eligibility=col("merged.status"), evidence=col("merged.evidence"),
        legitimacy=col("legit.verdict"), prior_id=col("prior_application"), mode=col("mode"), onsite_home=col("eligible.onsite_home") | at_home, cfg=cfg)
    rows = rows.withColumn("blocked_by", blocked)
    decision = scoring.decide(
        score=col("match.score"), blocked_by=col("blocked_by"), eligibility=col("merged.status"), legitimacy=col("legit.verdict"), mode=col("mode"), method=col("apply.method"), email=col("apply.email"), cfg=cfg)
    rows = rows.withColumn("decision", decision)
    return rows.withColumn("next_review", scoring.guarded_review(col("review_status"), col("decision.review_status")))
