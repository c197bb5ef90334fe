"""Match score and decision policy on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.config import DEFAULT, Config

#: Points of an eligibility verdict.
ELIGIBILITY_POINTS = {"eligible": 100, "likely_eligible": 80, "unclear": 50, "not_eligible": 0}
MANUAL = "Application requires manual interaction (web form or login)"
MANUAL_METHODS = ["ats_form", "external_form", "login_required"]


def clamp(c: Column) -> Column:
    """Rounded half to even into 0..100; null gives 0."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.bround(c.cast("double"), 0), F.lit(0)))).cast("int")


#: The sentences of points, blockers and decisions in this module are results that other systems compare.
def compensation(low: Column, high: Column, employment: Column, cfg: Config = DEFAULT) -> Column:
    """struct(score, reasoning)."""
    least, lenient = cfg.min_monthly_pay, employment.isin(cfg.allow_low_pay_for)
    reference = F.coalesce(high, low)
    money = lambda c: F.format_number(F.floor(c), 0)
    say = lambda points, *parts: F.struct((F.lit(points) if isinstance(points, int) else points).alias("score"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("reasoning"))
    cur = cfg.base_currency
    return (
        F.when(low.isNull() & high.isNull(), say(60, "Compensation not stated"))
        .when(low >= least, say(100, f"Pays at least {cur} ", money(low), "/month"))
        .when(high >= least, say(85, f"Range reaches {cur} ", money(high), "/month"))
        .when(reference >= 0.5 * least, say(F.when(lenient, 75).otherwise(55), f"Below minimum (about {cur} ", money(reference), "/month)"))
        .otherwise(say(F.when(lenient, 50).otherwise(25), f"Well below minimum (about {cur} ", money(reference), "/month)"))
    )


def match_score(components: dict[str, tuple[Column, Column]], weights: dict[str, int]) -> Column:
    """struct(score, breakdown): components are (score, reasoning) by name; missing ones count 0."""
    entries, total = [], F.lit(0.0)
    for name, weight in weights.items():
        score, why = components.get(name, (F.lit(None), F.lit(None)))
        score = clamp(score)
        points = score * weight / 100
        total = total + points
        entries += [F.lit(name), F.struct(score.alias("score"), F.lit(weight).alias("weight"), F.bround(points, 1).alias("points"), F.coalesce(why.cast("string"), F.lit("")).alias("reasoning"))]
    return F.struct(clamp(total).alias("score"), F.create_map(*entries).alias("breakdown"))


def blockers(*, real: Column, seniority_reasons: Column, senior_mismatch: Column, eligibility: Column, evidence: Column, legitimacy: Column, prior_id: Column, mode: Column, onsite_home: Column, cfg: Config = DEFAULT) -> Column:
    """The reasons why a posting must never be applied to, in order."""
    text = lambda when, *parts: F.when(when, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    rest = F.array(
        text((F.size(seniority_reasons) == 0) & senior_mismatch, "Requires significantly more experience than the candidate has"),
        text(eligibility == "not_eligible", f"Not open to {cfg.home_label}-based candidates: ", evidence),
        text(legitimacy == "suspicious", "Listing looks suspicious or scam-like"),
        text(prior_id.isNotNull(), "Already applied to this company for a similar role (application #", prior_id.cast("string"), ")"),
        text(mode.isin("onsite", "hybrid") & ~onsite_home, f"Requires working onsite outside {cfg.home_label}"),
    )
    return F.array_compact(F.concat(F.array(text(~real, "Not a real, open job posting")), seniority_reasons, rest))


def decide(*, score: Column, blocked_by: Column, eligibility: Column, legitimacy: Column, mode: Column, method: Column, email: Column, cfg: Config = DEFAULT) -> Column:
    """struct(recommendation, review_status, reasons, auto_blockers)."""
    high, low = cfg.auto_apply_min, cfg.approval_min
    note = lambda when, text: F.when(when, F.lit(text))
    auto = F.array_compact(F.array(
        note(~eligibility.isin("eligible", "likely_eligible"), f"{cfg.home_label} eligibility is not confirmed"),
        note(legitimacy != "legitimate", "Company legitimacy is not confirmed"),
        note(mode != "remote", "Not a fully remote role"),
        F.when(method == "unclear", "Application method is unclear").when(method.isin(MANUAL_METHODS), MANUAL).when((method == "email") & (F.coalesce(email, F.lit("")) == ""), "No application email address found"),
    ))
    shown = score.cast("string")
    out = lambda r, s, why, by: F.struct(F.lit(r).alias("recommendation"), F.lit(s).alias("review_status"), why.alias("reasons"), by.alias("auto_blockers"))
    line = lambda *parts: F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    none = F.array().cast("array<string>")
    passes = line("Match score ", shown, f" ≥ {high} and all automatic-application checks pass")
    if cfg.auto_apply_enabled:
        automatic = out("auto_apply_candidate", "pending_approval", passes, none)
    else:
        automatic = out("auto_apply_candidate", "auto_apply_disabled", F.concat(passes, F.array(F.lit("Automatic applications are disabled - review and apply yourself"))), none)
    return (
        F.when(F.size(blocked_by) > 0, out("blocked", "none", blocked_by, blocked_by))
        .when(score < low, out("ignore", "none", line("Match score ", shown, f" is below {low}"), F.array(F.lit("Score below approval threshold"))))
        .when((score >= high) & (F.size(auto) == 0), automatic)
        .when((score >= high) & (auto == F.array(F.lit(MANUAL))), out("manual_apply", "ready_to_apply", F.concat(line("Match score ", shown, f" ≥ {high}"), F.array(F.lit(MANUAL))), auto))
        .when(score >= high, out("approval_required", "pending_approval", line("Match score ", shown, f" ≥ {high} but: ", F.array_join(auto, "; ")), auto))
        .otherwise(out("approval_required", "pending_approval", F.concat(line("Match score ", shown, f" is between {low} and {high - 1}"), auto), F.when(F.size(auto) > 0, auto).otherwise(F.array(F.lit("Score below automatic-application threshold")))))
    )


#: Review states that the machine sets; all others are a person's.
MACHINE_REVIEW = ["none", "pending_approval", "ready_to_apply", "auto_apply_disabled"]


def guarded_review(current: Column, proposed: Column) -> Column:
    """The proposed state, unless a person set the current one."""
    return F.when(current.isNull() | current.isin(MACHINE_REVIEW), proposed).otherwise(current)
