"""Rules on postings: each adds columns from columns of the same row, so none shuffles.

A posting has title, description, company_name, company_website, location_text, location_restrictions
(array), remote_type, employment_type, source, source_url, apply_url, apply_email, posted_at, expires_at,
pay_min, pay_max (a month, base currency), seniority_hint. The rules read folded texts (see functions.text.fold)
that are columns of their own: title_folded, description_folded, location_folded, whole_folded (title and
description, a line each).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.config import DEFAULT, Config
from gleanery.functions import urls
from gleanery.functions.dates import staleness
from gleanery.functions.text import emails, first_term, fold, has_any, has_term, hits, let, written_in

#: Wordings that the rules look for.
GENERIC_TITLE = r"\b(?:developer|engineer|programmer|intern|trainee|graduate)\b"
OWN_WORDS = ["react", "script", "frontend", "front-end", "next"]
OWN_STACK = r"\b(?:react|typescript|javascript|frontend|front-end|next\.?js)\b"
YEARS = r"(?i)(?<![\d.])(\d{1,2})\s*(?:\+|plus)?\s*(?:(?:-|–|to)\s*\d{1,2}\s*\+?\s*)?(?:years?|yrs?)\b(?![- ]old)"
EXPERIENCE = r"\b(?:experience|experienced|professional|working|commercial|industry|hands[- ]on|background|track record)\b"
OPTIONAL = r"\b(?:preferred|nice to have|nice-to-have|bonus|ideally|a plus|advantage|advantageous|desirable)\b"
JUNIOR = r"\b(?:junior|jr|entry[- ]level|intern|internship|trainee|graduate|apprentice|associate)\b"
JUNIOR_QUEUE = r"\b(?:junior|jr|entry[- ]level|intern|internship|trainee|graduate|apprentice|associate|fresher)\b"
SENIOR_QUEUE = r"\b(?:senior|sr|staff|principal|lead|head|director|architect|manager|expert)\b"
SENIOR_HINT = r"(?i)\b(?:senior|lead|principal|director|executive|mid-senior|staff)\b"
COUNTRIES = r"u\.s\.?|usa|united states|canada|uk|united kingdom|eu|european union|europe|emea|latam|latin america|north america|india|germany|australia|brazil|mexico|philippines"
REGION, REGION_NOT_US = rf"(?:the\s)?(?:us|{COUNTRIES})", rf"(?:the\s)?(?:{COUNTRIES})"
US_ONLY = r"\b(?:US|USA|U\.S\.)[\s-]*(?:only|Only|ONLY|based only|residents only)\b"
RESTRICTIONS = [
    rf"\b{REGION_NOT_US}[\s-]*(?:only|based only|residents only)\b",
    rf"\bonly (?:open to |accepting |hiring |considering )?(?:candidates |applicants |people |residents )?(?:who are )?(?:based |located |living |residing )?in {REGION}\b",
    rf"\bmust (?:be )?(?:currently )?(?:based|located|reside|residing|live|living) in {REGION}\b",
    rf"\b(?:legally )?(?:authori[sz]ed|eligible) to work in {REGION}\b",
    rf"\b(?:unable|not able) to (?:hire|employ|sponsor)[^.]{{0,30}}outside (?:of )?{REGION}\b",
    rf"\bremote\s*[-–(,:]\s*{REGION}\s*\)?\s*$",
]
#: For each of these a word that what it matches holds: texts without the word are not searched.
RESTRICTION_WORDS = ["only", "only", "must ", "to work in ", "outside ", "remote"]
APPLY_WORDS = r"\b(?:apply|application|send|email|e-mail|cv|resume|résumé|portfolio)\b"
NO_APPLY_EMAIL = r"(?i)^(?:no-?reply|privacy|legal|security|abuse|dpo|gdpr|accessibility)@"


def home_exclusions(home: str) -> list[str]:
    return [
        rf"\b(?:not|cannot|can't|unable to|don't|do not) (?:hire|accept|consider|employ|support)[^.]{{0,60}}\b{home}\b",
        rf"\b{home}\b[^.]{{0,40}}\b(?:not eligible|excluded|not supported|not accepted|restricted)\b",
        rf"\bexclud\w*[^.]{{0,80}}\b{home}\b",
    ]


def found(text: Column, patterns: dict[str, list[str]]) -> Column:
    """What the first of the patterns that matches matches, null for none. patterns: each with words of which every match
    holds one."""
    return F.coalesce(*[F.when(written_in(text, words), F.regexp_substr(text, F.lit(p))) for p, words in patterns.items()])


def home_local(place: Column, source: Column, cfg: Config = DEFAULT) -> Column:
    return F.coalesce(source.isin(cfg.local_sources), F.lit(False)) | has_any(place, cfg.home_places)


#: The sentences in these rules are results that other systems compare: wordings of relevance, seniority,
#: eligibility and merged verdicts.
def relevance(t: Column, description: Column, local: Column, cfg: Config = DEFAULT) -> Column:
    """struct(ok, reason). Only the first excluded term counts, and local postings are let off some."""
    quoted = lambda a, b: F.concat(F.lit(a), b, F.lit("'"))

    def judged(seen: Column) -> Column:
        excluded, included, generic = seen["excluded"], seen["included"], seen["generic"]
        blocked = excluded.isNotNull() & ~(seen["local"] & F.coalesce(excluded.isin(cfg.home_relaxed_exclude_terms), F.lit(False)))
        reason = (
            F.when(blocked, quoted("Title matches excluded term '", excluded))
            .when(included.isNotNull(), quoted("Title matches target term '", included))
            .when(generic, "Generic technical title and posting mentions the candidate's stack")
            .otherwise("Title is not related to the target roles")
        )
        return F.struct((~blocked & (included.isNotNull() | generic)).alias("ok"), reason.alias("reason"))

    included = F.coalesce(first_term(t, cfg.include_title_terms), F.when(local, first_term(t, cfg.home_extra_include_terms)))
    generic = t.rlike(GENERIC_TITLE) & written_in(description, OWN_WORDS) & description.rlike(OWN_STACK)
    return let(F.struct(local.alias("local"), first_term(t, cfg.exclude_title_terms).alias("excluded"), included.alias("included"), generic.alias("generic")), judged)


def required_years(description: Column) -> Column:
    """The largest number of years that a sentence demands, null if none does."""
    told = lambda s: written_in(F.lower(s), ["year", "yr"])
    sentences = F.split(description, r"[.\n;•]|\s-\s")
    asking = F.filter(sentences, lambda s: told(s) & s.rlike(EXPERIENCE) & ~s.rlike(OPTIONAL))
    years = F.flatten(F.transform(asking, lambda s: F.transform(F.regexp_extract_all(s, F.lit(YEARS), F.lit(1)), lambda x: x.cast("int"))))
    return F.when(told(description), F.array_max(F.filter(years, lambda y: y <= 20)))


def seniority(t: Column, description: Column, cfg: Config = DEFAULT) -> Column:
    """struct(blocked, reasons, required_years, junior_title)."""

    def judged(seen: Column) -> Column:
        years, junior, term = seen["years"], seen["junior"], seen["term"]
        reasons = F.array_compact(F.array(
            F.when(term.isNotNull() & ~junior, F.concat(F.lit("Senior-level title ('"), term, F.lit("')"))),
            F.when(years > cfg.max_required_years, F.concat(F.lit("Requires "), years.cast("string"), F.lit(f"+ years of experience (limit {cfg.max_required_years})"))),
        ))
        return F.struct((F.size(reasons) > 0).alias("blocked"), reasons.alias("reasons"), years.alias("required_years"), junior.alias("junior_title"))

    seen = F.struct(required_years(description).alias("years"), t.rlike(JUNIOR).alias("junior"), first_term(t, cfg.blocked_title_terms).alias("term"))
    return let(seen, judged)


def hint_blocks(hint: Column, t: Column) -> Column:
    """A seniority hint of the source blocks unless the title is junior."""
    return F.coalesce(hint.rlike(SENIOR_HINT), F.lit(False)) & ~t.rlike(JUNIOR)


def eligibility(location: Column, place: Column, restrictions: Column, mode: Column, description: Column, text: Column, cfg: Config = DEFAULT) -> Column:
    """struct(status, evidence, explicit, onsite_home): the first test that says something decides."""
    home = cfg.home_label
    at_home = has_any(place, cfg.home_terms)
    shown = F.coalesce(location, F.lit(""))
    excluded = found(text, {p: [cfg.home_name] for p in home_exclusions(cfg.home_name)})
    on_site = mode.isin("onsite", "hybrid")
    regions = F.transform(F.filter(F.coalesce(restrictions, F.array().cast("array<string>")), lambda r: F.trim(r) != ""), lambda r: F.regexp_replace(F.regexp_replace(fold(r), r"^[ .,\-]+|[ .,\-]+$", ""), r"\s+", " "))
    listed = F.array_join(restrictions, ", ")
    any_of = lambda terms: F.exists(regions, lambda r: has_any(r, terms))
    restriction = F.coalesce(found(F.coalesce(description, F.lit("")), {US_ONLY: ["nly", "ONLY"]}), found(text, {p: [w] for p, w in zip(RESTRICTIONS, RESTRICTION_WORDS, strict=True)}))
    open_term = first_term(text, cfg.open_terms, whole=True)
    mention = first_term(text, cfg.region_includes, whole=True)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def verdict(status: str, evidence: Column | str, explicit: bool, onsite: bool = False) -> Column:
        return F.struct(F.lit(status).alias("status"), (F.lit(evidence) if isinstance(evidence, str) else evidence).alias("evidence"), F.lit(explicit).alias("explicit"), F.lit(onsite).alias("onsite_home"))

    role = F.initcap(mode)
    has_regions, has_place = F.size(regions) > 0, place != ""
    return (
        F.when(excluded.isNotNull(), verdict("not_eligible", say('Posting says: "', excluded, '"'), True))
        .when(on_site & at_home, verdict("eligible", say(role, f" role located in {home} (", shown, ")"), True, True))
        .when(on_site & has_place, verdict("not_eligible", say(role, f" role located outside {home} (", shown, ")"), True))
        .when(has_regions & F.exists(regions, lambda r: (r == cfg.home_code) | has_term(r, cfg.home_name)), verdict("eligible", f"Location restrictions include {home}", True))
        .when(has_regions & any_of(cfg.positive_terms), verdict("eligible", say("Open location: ", listed), True))
        .when(has_regions & any_of(cfg.region_includes), verdict("likely_eligible", say(f"Region includes {home}: ", listed), False))
        .when(has_regions, verdict("not_eligible", say("Restricted to: ", listed), True))
        .when(at_home, verdict("eligible", say(f"Location mentions {home} (", shown, ")"), True))
        .when(has_place & has_any(place, cfg.positive_terms), verdict("eligible", say("Location: ", shown), True))
        .when(has_place & has_any(place, cfg.region_includes), verdict("likely_eligible", say(f"Location region includes {home}: ", shown), False))
        .when(has_place & has_any(place, cfg.region_excludes), verdict("not_eligible", say("Location limited to ", shown), True))
        .when(has_term(text, cfg.home_name), verdict("eligible", f"Posting mentions {home}", True))
        .when(restriction.isNotNull() & open_term.isNotNull(), verdict("unclear", say('Conflicting signals: "', open_term, '" vs "', restriction, '"'), False))
        .when(restriction.isNotNull(), verdict("not_eligible", say('Posting says: "', restriction, '"'), True))
        .when(open_term.isNotNull(), verdict("eligible", say('Posting says: "', open_term, '"'), False))
        .when(mention.isNotNull(), verdict("likely_eligible", say("Posting mentions ", mention), False))
        .otherwise(verdict("unclear", "No location restriction information found", False))
    )


#: Order of eligibility from the most cautious.
CAUTION = {"not_eligible": 0, "unclear": 1, "likely_eligible": 2, "eligible": 3}


def merged_eligibility(rule: Column, rule_evidence: Column, other: Column, other_evidence: Column) -> Column:
    """struct(status, evidence) of the rules' verdict and another one."""
    no_rule, no_other = rule == "not_eligible", other == "not_eligible"
    against = F.when(no_rule, other).otherwise(rule)
    rank = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in CAUTION.items()], F.lit(1))
    pair = lambda s, e: F.struct(s.alias("status"), e.alias("evidence"))
    return (
        F.when(no_rule & no_other, pair(rule, F.concat(rule_evidence, F.lit(" | AI: "), other_evidence)))
        .when((no_rule | no_other) & (against == "eligible"), pair(F.lit("unclear"), F.concat(F.lit("Conflicting signals - rules: "), rule_evidence, F.lit(" | AI ("), other, F.lit("): "), other_evidence)))
        .when(no_rule, pair(rule, rule_evidence))
        .when(no_other, pair(other, F.concat(F.lit("AI: "), other_evidence)))
        .when(rule == "unclear", pair(other, F.when(other != "unclear", other_evidence).otherwise(rule_evidence)))
        .when((other == "unclear") | (rank(rule) <= rank(other)), pair(rule, rule_evidence))
        .otherwise(pair(other, other_evidence))
    )


def apply_method(apply_url: Column, apply_email: Column, description: Column, cfg: Config = DEFAULT) -> Column:
    """struct(method, email)."""
    url, mail = F.nullif(apply_url, F.lit("")), F.nullif(apply_email, F.lit(""))
    name = urls.host(url)
    sentences = F.filter(F.split(F.coalesce(description, F.lit("")), r"(?<=[.!?])\s+|\n"), lambda s: s.contains("@") & F.lower(s).rlike(APPLY_WORDS))
    named = F.when(description.contains("@"), F.get(F.filter(F.flatten(F.transform(sentences, emails)), lambda m: ~m.rlike(NO_APPLY_EMAIL)), F.lit(0)))
    none = F.lit(None).cast("string")
    pair = lambda m, e: F.struct(F.lit(m).alias("method"), e.alias("email"))
    return (
        F.when(mail.isNotNull(), pair("email", mail))
        .when(F.lower(url).startswith("mailto:"), pair("email", F.substring_index(F.substring(url, 8, 10_000), "?", 1)))
        .when(url.isNotNull() & urls.on_domains(name, cfg.ats_domains), pair("ats_form", none))
        .when(url.isNotNull() & urls.on_domains(name, cfg.no_fetch_domains + cfg.login_domains), pair("login_required", none))
        .when(url.isNotNull(), pair("external_form", none))
        .when(named.isNotNull(), pair("email", named))
        .otherwise(pair("unclear", none))
    )


def legitimacy(cfg: Config = DEFAULT, *, text: Column, description: Column, source: Column, source_url: Column, apply_url: Column, apply_email: Column, company: Column, website: Column, pay_min: Column, pay_max: Column, domain_age: Column) -> Column:
    """struct(score, verdict, flags): a base score and flags that move it. The red flags come after five."""
    site = F.when(F.coalesce(website, F.lit("")) != "", urls.registrable(website)).otherwise("")
    apply_host = urls.host(apply_url)

    def flag(when: Column, code: str, severity: str, message: Column | str, delta: int) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(delta).alias("delta")))

    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    mail = F.lower(F.coalesce(apply_email, F.lit("")))
    age = domain_age.cast("string")
    pay = F.coalesce(F.nullif(pay_max, F.lit(0.0)), pay_min)
    flags = [
        flag(urls.on_domains(urls.host(source_url), cfg.ats_domains) | urls.on_domains(apply_host, cfg.ats_domains), "ats_hosted", "positive", "Posting is hosted on a known applicant tracking system", 20),
        flag(source.isin(cfg.curated_sources), "curated_board", "positive", say("Listed on an established job board (", source, ")"), 5),
        flag(site != "", "company_website", "positive", say("Company website present (", site, ")"), 5),
        flag((site != "") & (apply_host != "") & (urls.registrable(apply_host) == site), "apply_on_company_domain", "positive", "Application link is on the company's own domain", 10),
        flag(F.trim(F.coalesce(company, F.lit(""))) == "", "no_company", "medium", "No company name given", -15),
        flag(F.element_at(F.split(mail, "@"), -1).isin(cfg.free_email_domains), "free_email", "medium", say("Applications go to a free email address (", mail, ")"), -10),
        flag(F.length(F.coalesce(description, F.lit(""))) < 250, "vague_description", "low", "Very short or vague description", -8),
        flag(domain_age < 30, "new_domain", "high", say("Company domain registered only ", age, " days ago"), -30),
        flag((domain_age >= 30) & (domain_age < cfg.min_domain_age_days), "young_domain", "medium", say("Company domain is ", age, " days old"), -15),
        flag((pay > 1_500_000) & has_term(text, "no experience"), "unrealistic_pay", "medium", "Unusually high pay for a no-experience role", -15),
    ]
    named = lambda terms, code, severity, say, delta: F.transform(hits(text, terms, whole=True), lambda t: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.concat(F.lit(say), t, F.lit("'")).alias("message"), F.lit(delta).alias("delta")))
    red = F.concat(named(cfg.strong_red_flags, "payment_request", "high", "Scam indicator: mentions '", -40), named(cfg.weak_red_flags, "weak_red_flag", "medium", "Warning sign: mentions '", -12))
    kept = F.concat(F.array_compact(F.array(*flags[:5])), red, F.array_compact(F.array(*flags[5:])))

    def total(f: Column) -> Column:
        score = F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate(f, F.lit(60), lambda n, x: n + x["delta"])))
        return let(score, lambda n: F.struct(n.alias("score"), verdict_of(n, strong(f)).alias("verdict"), f.alias("flags")))

    return let(kept, total)


def strong(flags: Column) -> Column:
    return F.exists(flags, lambda f: f["severity"] == "high")


def verdict_of(score: Column, has_strong: Column) -> Column:
    return F.when(has_strong | (score < 40), "suspicious").when(score < 65, "uncertain").otherwise("legitimate")


#: Points of another verdict, and the order of verdicts.
VERDICT_POINTS = {"legitimate": 80, "uncertain": 50, "suspicious": 15}
VERDICT_RANK = {"legitimate": 0, "uncertain": 1, "suspicious": 2}


def merged_legitimacy(own: Column, other: Column, concerns: Column) -> Column:
    """struct(score, verdict, flags): the blended score, never better than the heuristic's verdict."""
    points = F.coalesce(*[F.when(other == k, F.lit(v)) for k, v in VERDICT_POINTS.items()], F.lit(50))
    score = F.bround(0.6 * own["score"] + 0.4 * points, 0).cast("int")
    added = F.transform(F.coalesce(concerns, F.array().cast("array<string>")), lambda c: F.struct(F.lit("ai_concern").alias("code"), F.lit("medium").alias("severity"), c.alias("message"), F.lit(0).alias("delta")))
    blended = verdict_of(score, strong(own["flags"]))
    rank = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in VERDICT_RANK.items()])
    verdict = F.when(other == "suspicious", "suspicious").when(rank(own["verdict"]) > rank(blended), own["verdict"]).otherwise(blended)
    return F.struct(score.alias("score"), verdict.alias("verdict"), F.concat(own["flags"], added).alias("flags"))


def merged_apply(own: Column, method: Column, email: Column, description: Column) -> Column:
    """struct(method, email): the rules' way to apply; where that is unclear, the analysts', an address only if it
    stands in the posting."""
    written = F.coalesce((F.coalesce(email, F.lit("")) != "") & F.lower(F.coalesce(description, F.lit(""))).contains(F.lower(email)), F.lit(False))
    pair = lambda m, e: F.struct(m.alias("method"), e.alias("email"))
    told = (own["method"] == "unclear") & F.coalesce(method != "unclear", F.lit(False))
    return F.when(told & (method == "email") & written, pair(method, email)).when(told & (method != "email"), pair(method, own["email"])).otherwise(pair(own["method"], own["email"]))


def merged_seniority(own: Column, years: Column, cfg: Config = DEFAULT) -> Column:
    """The rules' reasons; where there are none, the years that the analysts read, if they are too many."""
    most = cfg.max_required_years
    said = F.concat(F.lit("Requires "), years.cast("string"), F.lit(f"+ years of experience (limit {most})"))
    return F.when((F.size(own) == 0) & (years > most), F.array(said)).otherwise(own)


#: Hosts of the feeds themselves.
FEED_HOSTS = ["remotive.com", "remoteok.com", "weworkremotely.com", "himalayas.app", "jobicy.com", "workingnomads.com", "ycombinator.com", "arbeitnow.com"]


def domain_to_check(website: Column, apply_url: Column, source: Column, cfg: Config = DEFAULT, still_checked: str = "hackernews") -> Column:
    """The company's domain whose age is worth knowing, null for hosted and curated postings."""
    hosted = cfg.ats_domains + cfg.no_fetch_domains + cfg.login_domains + FEED_HOSTS
    own = lambda u: F.when((urls.host(u) != "") & ~urls.on_domains(urls.host(u), hosted), urls.registrable(urls.host(u)))
    curated = [s for s in cfg.curated_sources if s != still_checked]
    return F.when(~F.coalesce(source.isin(curated), F.lit(False)), F.coalesce(own(website), own(apply_url)))


def queue_score(cfg: Config = DEFAULT, *, t: Column, d: Column, text: Column, place: Column, mode: Column, source: Column, pay_min: Column, pay_max: Column, eligible: Column) -> Column:
    """struct(score, reasons): who gets analysed first. text: the folded title and start of the description."""
    tier = F.coalesce(*[F.when(has_any(t, terms), F.struct(F.lit(p).alias("points"), F.concat(F.lit("Title matches '"), first_term(t, terms), F.lit(f"' (+{p})")).alias("reason"))) for p, terms in cfg.title_tiers],
        F.struct(F.lit(-10).alias("points"), F.lit("Title has no direct role match (-10)").alias("reason")))
    step = lambda when, points, reason: F.when(when, F.struct((F.lit(points) if isinstance(points, int) else points).alias("points"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason")))

    def mentions(stack: Column) -> Column:
        points = F.least(F.lit(15), 3 * F.size(stack))
        return step(F.size(stack) > 0, points, F.concat(F.lit("Mentions "), F.array_join(F.slice(stack, 1, 5), ", "), F.lit(" (+"), points.cast("string"), F.lit(")")))

    by_status = {"eligible": 12, "likely_eligible": 6, "not_eligible": -30}
    parts = F.array_compact(F.array(
        tier,
        F.when(t.rlike(JUNIOR_QUEUE), F.struct(F.lit(15).alias("points"), F.lit("Junior / entry-level title (+15)").alias("reason"))).otherwise(step(t.rlike(SENIOR_QUEUE), -25, "Senior-sounding title (-25)")),
        let(hits(text, cfg.stack_terms, whole=True), mentions),
        *[step(eligible == k, v, f"{cfg.home_label} eligibility '{k}' ({v:+d})") for k, v in by_status.items()],
        step(mode == "remote", 5, "Remote role (+5)"),
        step(has_any(place, cfg.home_places[:5]), 10, f"Located in {cfg.home_label} (+10)"),
        step((F.coalesce(pay_min, F.lit(0.0)) != 0) | (F.coalesce(pay_max, F.lit(0.0)) != 0), 4, "Pay is stated (+4)"),
        step(source.isin(cfg.trusted_sources), 4, F.concat(F.lit("Structured source '"), source, F.lit("' (+4)"))),
        step(F.length(d) < cfg.min_description_chars, -8, "Very short description (-8)"),
    ))
    score = lambda p: F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate(p, F.lit(40), lambda n, x: n + x["points"])))
    return let(parts, lambda p: F.struct(score(p).alias("score"), F.transform(p, lambda x: x["reason"]).alias("reasons")))


def stopped(at: str, blocked: bool, reason: Column) -> Column:
    return F.struct(F.lit(at).alias("stop_stage"), F.lit("filtered_out").alias("status"), F.lit("blocked" if blocked else None).cast("string").alias("recommendation"), reason.alias("reason"))


def first_stops(stale: Column, relevant: Column) -> Column:
    """The first two stages of `stage`; null where neither stops a posting."""
    return F.when(stale.isNotNull(), stopped("stale", False, stale)).when(~relevant["ok"], stopped("relevance", False, relevant["reason"]))


def stage(cfg: Config = DEFAULT, *, stale: Column, relevant: Column, senior: Column, eligible: Column, legit: Column, prior_application: Column) -> Column:
    """struct(stop_stage, status, recommendation, reason): where the chain of rules stops a posting."""
    none = F.lit(None).cast("string")
    stop = stopped
    return (
        first_stops(stale, relevant)
        .when(senior["blocked"], stop("seniority", True, F.array_join(senior["reasons"], "; ")))
        .when((eligible["status"] == "not_eligible") & eligible["explicit"], stop("eligibility", True, F.concat(F.lit(f"Not open to {cfg.home_label}-based candidates: "), eligible["evidence"])))
        .when(strong(legit["flags"]), stop("scam", True, F.concat(F.lit("Listing looks like a scam: "), F.array_join(F.transform(F.filter(legit["flags"], lambda f: f["severity"] == "high"), lambda f: f["message"]), "; "))))
        .when(prior_application.isNotNull(), stop("prior_application", True, F.concat(F.lit("Already applied to this company for a similar role (application #"), prior_application.cast("string"), F.lit(")"))))
        .otherwise(F.struct(F.lit("passed").alias("stop_stage"), F.lit("awaiting_ai").alias("status"), none.alias("recommendation"), none.alias("reason")))
    )


def stale(posted: Column, expires: Column, now: Column, cfg: Config = DEFAULT) -> Column:
    return staleness(posted, expires, now, cfg.max_posting_age_days)
