"""Duplicate postings: order-dependent leaders by company, and the routing of found links."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.config import DEFAULT, Config
from gleanery.functions import urls
from gleanery.functions.text import title_similarity
from gleanery.operators.likeness import alike
from gleanery.operators.views import capped
from gleanery.session import written

col = F.col
#: Leaders of a company that a posting is compared with where they are capped: the earliest ones. Titles of a company that a task scans.
LEADERS = 200


def similarity(a: str, b: str) -> float:
    """As functions.text.title_similarity, for two titles within a task: the bits of one number are the row of
    the table of common subsequences, a step for each letter of the other title."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not x and not y:
        return 100.0
    if x == y:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(x) - row.bit_count()) / (len(x) + len(y))


def first_leaders(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """The leaders among titles of one company that no earlier leader is like: few rows at a time.
    `room` says how many more the company may have."""
    rows = rows.sort_values(["seen", "id"])
    held: list[str] = []
    keep = []
    for title in rows["title_norm"]:
        leads = len(held) < rows["room"].iloc[0] and all(similarity(title, t) < least for t in held)
        held += [title] if leads else []
        keep.append(leads)
    return rows.loc[keep, ["company_norm", "title_norm", "id", "seen"]].rename(columns={"title_norm": "leader_title", "id": "leader"})


def independent(block: DataFrame, least: float) -> DataFrame:
    """As first_leaders, for blocks of any size and without `room`: titles meet by the index, and in rounds those
    lead that no open title before them is like, and what is like them is no longer open."""
    at = F.struct("seen", "id")
    later, earlier = block.select("company_norm", "title_norm", at.alias("_at")), block.select("company_norm", col("title_norm").alias("leader_title"), at.alias("_lead"))
    pairs = alike(later, earlier, ["company_norm"], "title_norm", "leader_title", least).join(later, ["company_norm", "title_norm"]).join(earlier, ["company_norm", "leader_title"])
    pairs = written(pairs.where("_lead < _at").select("company_norm", "title_norm", "leader_title"), "title_pairs")
    still, found = block.select("company_norm", "title_norm", "id", "seen"), None
    while True:
        waits = pairs.select("company_norm", "title_norm").distinct()
        new = written(still.join(waits, ["company_norm", "title_norm"], "left_anti").select("company_norm", col("title_norm").alias("leader_title"), col("id").alias("leader"), "seen"), "block_leaders")
        found = new if found is None else found.unionByName(new)
        led = pairs.join(new, ["company_norm", "leader_title"], "left_semi").select("company_norm", "title_norm").distinct()
        still = written(still.join(waits, ["company_norm", "title_norm"], "left_semi").join(led, ["company_norm", "title_norm"], "left_anti"), "block_open")
        if still.isEmpty():
            return found
        ends = still.select("company_norm", "title_norm")
        pairs = pairs.join(ends, ["company_norm", "title_norm"], "left_semi").join(ends.withColumnRenamed("title_norm", "leader_title"), ["company_norm", "leader_title"], "left_semi")
        pairs = written(pairs, "open_pairs")


def leaders(titles: DataFrame, least: float, whole: bool = False) -> DataFrame:
    """(company_norm, leader_title, leader, seen) for distinct titles (company_norm, title_norm, seen, id).

    In order of arrival a title leads if it is like no leader before it, up to LEADERS of a company, or all with `whole`. Rounds: the
    first LEADERS open titles of each company are scanned, then all later titles that are like a new leader are
    no longer open, and those of companies that have all their leaders. The first open title always leads, and most
    of a block do, so nearly all companies take one round. A task sees LEADERS titles of a company at a time; the
    others meet the leaders by an index of runs of letters, dealt over all tasks. With `whole` each further block has four
    times the titles, which meet by that index too, so the rounds grow with the logarithm of a company's titles."""
    order = W.partitionBy("company_norm").orderBy("seen", "id")
    still, found, most = titles.withColumn("room", F.lit(2**31 - 1 if whole else LEADERS)), None, LEADERS
    while True:
        still = written(still, "open_titles")
        block = still.withColumn("_rank", F.row_number().over(order)).where(col("_rank") <= most).drop("_rank")  # limited within tasks first
        block = written(block, "title_block")
        if most == LEADERS:
            new = block.groupBy("company_norm").applyInPandas(lambda rows: first_leaders(rows, least), "company_norm string, leader_title string, leader long, seen long")
        else:
            new = independent(block, least)
        new = written(new, "leaders")
        most *= 4 if whole else 1
        found = new if found is None else found.unionByName(new)
        ends = block.groupBy("company_norm").agg(F.max(F.struct("seen", "id")).alias("_end"))
        had = new.groupBy("company_norm").agg(F.count(F.lit(1)).alias("_new"))
        rest = still.join(ends, "company_norm").where(F.struct("seen", "id") > col("_end")).join(had, "company_norm", "left")
        rest = rest.withColumn("room", (col("room") - F.coalesce("_new", F.lit(0))).cast("int")).where("room > 0").select(*still.columns)
        rest = written(rest, "later_titles")
        if rest.isEmpty():
            return found
        led = alike(rest, new, ["company_norm"], "title_norm", "leader_title", least).select("company_norm", "title_norm").distinct()
        still = rest.join(led, ["company_norm", "title_norm"], "left_anti")


def near_duplicates(postings: DataFrame, now_hour: int, cfg: Config = DEFAULT, whole: bool = False) -> DataFrame:
    """(id, duplicate_of) for postings (id, company_norm, title_norm, first_seen_hour).

    In order of arrival a row is the duplicate of its company's leader with its title, else of the most
    similar leader (the earliest on ties) from the threshold on, else it becomes a leader itself. Rows
    without company or title, and rows older than the window (which can be no candidates), are originals.
    A company has LEADERS leaders at most, or with `whole` all that it has.

    Only the first row of a title can become a leader: whatever kept it from that keeps later rows of the
    title from it too. So leaders are sought among distinct titles, not rows, and rows then take the best of
    the leaders before them by a join on company and title."""
    old = now_hour - 24 * cfg.posting_window_days
    least = float(cfg.posting_title_similarity)
    rows = postings.select(col("id").cast("long"), F.coalesce("company_norm", F.lit("")).alias("company_norm"), F.coalesce("title_norm", F.lit("")).alias("title_norm"), col("first_seen_hour").cast("long").alias("seen"))
    can = (col("company_norm") != "") & (col("title_norm") != "") & (col("seen") > old)
    rows = written(rows, "postings")
    alone = rows.where(~F.coalesce(can, F.lit(False))).select("id", F.lit(None).cast("long").alias("duplicate_of"))
    rows = rows.where(can)
    first = F.min(F.struct("seen", "id")).alias("f")  # aggregated before the shuffle
    titles = rows.groupBy("company_norm", "title_norm").agg(first).select("company_norm", "title_norm", "f.seen", "f.id")
    found = leaders(titles, least, whole)
    near = alike(titles, found, ["company_norm"], "title_norm", "leader_title", least).join(found, ["company_norm", "leader_title"])
    score = title_similarity(col("title_norm"), col("leader_title"))
    options = near.groupBy("company_norm", "title_norm").agg(F.sort_array(F.collect_list(F.struct((-score).alias("s"), "seen", "leader"))).alias("options"))  # those that are like this title
    best = F.get(F.filter("options", lambda x: (x["seen"] < col("seen")) | ((x["seen"] == col("seen")) & (x["leader"] < col("id")))), F.lit(0))
    return rows.join(options, ["company_norm", "title_norm"], "left").select("id", best["leader"].alias("duplicate_of")).unionByName(alone)


def exact(incoming: DataFrame) -> DataFrame:
    """One row of each url_hash: the first arrival, with the last time it was seen and how often.

    Aggregates before it shuffles, so a page that is seen very often costs one row a task."""
    first = F.min_by(F.struct(*incoming.columns), F.struct("seen_hour", "id")).alias("first")
    seen = incoming.groupBy("url_hash").agg(first, F.max("seen_hour").alias("last_seen_hour"), F.count(F.lit(1)).alias("sightings"))
    return seen.select("first.*", "last_seen_hour", "sightings")


BINARY = r"(?i)\.(?:pdf|docx?|pptx?|xlsx?|png|jpe?g|gif|zip|mp4)(?:\?|$)"


def valid_link(url: Column) -> Column:
    return url.rlike("^https?://") & (F.length(url) <= 2000) & ~url.rlike(BINARY)


def link_outcomes(links: DataFrame, boards: DataFrame, known_urls: DataFrame, cfg: Config = DEFAULT, auto_discover: bool = True, key: Callable[[Column], Column] = urls.url_key) -> DataFrame:
    """links (id, run_id, url, ...) with an outcome each: invalid, board_ignored, board_known, board_new,
    lead, url_known, page_queued, page_deferred.

    boards (provider, slug) and known_urls (url_hash, as `key` makes them of addresses) are what is stored. Within the links the first of a
    board or page (by id) is new, later ones are known. Pages are queued within the caps of their run. The
    links meet one table of boards and one of pages, both aggregated before."""
    url = F.trim("url")
    rows = links.withColumn("url", url).withColumns({"_valid": F.coalesce(valid_link(url), F.lit(False)), "_board": urls.board(url), "_key": key(url)})
    lead = urls.on_domains(urls.host(col("url")), cfg.no_fetch_domains)
    kind = F.when(~col("_valid"), "invalid").when(col("_board").isNotNull(), "board").when(lead, "lead").otherwise("page")
    rows = rows.withColumns({"_provider": col("_board.provider"), "_slug": col("_board.slug"), "_kind": kind})

    def firsts(what: str, keys: list[str], stored: DataFrame) -> DataFrame:
        """Each key with the first link that has it and whether it is stored."""
        seen = rows.where(col("_kind") == what).groupBy(*keys).agg(F.min("id").alias(f"_first_{what}"))
        return seen.join(stored.distinct().withColumn(f"_stored_{what}", F.lit(True)), keys, "left")

    rows = rows.join(firsts("board", ["_provider", "_slug"], boards.select(col("provider").alias("_provider"), col("slug").alias("_slug"))), ["_provider", "_slug"], "left")
    rows = rows.join(firsts("page", ["_key"], known_urls.select(col("url_hash").alias("_key"))), "_key", "left")
    new = lambda what: F.col(f"_stored_{what}").isNull() & (col(f"_first_{what}") == col("id"))
    board = F.when(F.lit(not auto_discover), "board_ignored").when(new("board"), "board_new").otherwise("board_known")
    told = F.when(col("_kind") == "board", board).when((col("_kind") == "page") & new("page"), "page").when(col("_kind") == "page", "url_known").otherwise(col("_kind"))
    rows = rows.withColumn("outcome", told)
    fresh = rows.where("outcome = 'page'").select("run_id", "id", F.lit("page").alias("kind"))
    queued = capped(fresh, "run_id", ["id"], cfg.max_tasks_per_run, {"page": cfg.max_pages_per_run}).select("id", "admitted")
    rows = rows.join(queued, "id", "left")
    page = F.when(col("admitted"), "page_queued").otherwise("page_deferred")
    return rows.withColumn("outcome", F.when(col("outcome") == "page", page).otherwise(col("outcome"))).select(*links.columns, "outcome")
