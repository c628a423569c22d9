"""Entity resolution and link grading, with column names as parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purselake.functions.exprs import RESIDUE_WORDS, holds_family, normalize_name, normalize_title, title_jaccard
from purselake.operators.narratives import contiguous_pairs
from purselake.operators.windows import pick_first
from purselake.sources.lake import written


def resolve_duplicates(df: DataFrame, key: list[str], partition: str, modified: str) -> DataFrame:
    """Newest copy of repeated keys, all rows of others. A key is repeated cleanly when it has
    two copies in two partitions with two different dates; other repeated keys raise."""
    stats = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.countDistinct(partition).alias("__p"), F.count(modified).alias("__d"), F.countDistinct(modified).alias("__dd"), F.max(modified).alias("__m"))
    repeated = stats.filter("__n > 1")
    odd = repeated.filter("__n <> 2 OR __p <> 2 OR __d <> 2 OR __dd <> 2")
    if not odd.isEmpty():
        raise ValueError(f"ambiguous copies, first key: {odd.select(*key).first()}")
    single = df.join(repeated, key, "left_anti")
    kept = df.join(repeated.select(*key, "__m"), key).filter(F.col(modified) == F.col("__m")).drop("__m")
    return single.unionByName(kept.select(*df.columns))


def entity_crosswalk(df: DataFrame, recipient: str, name: str, parent_id: str, parent_name: str, amount: str, excluded: DataFrame | None = None) -> DataFrame:
    """Recipient -> family: the parent pair with most money, and the dominant name; excluded
    (recipient, parent) pairs go before ranking. Family: parent name, parent id, own name, id."""
    rows = df if excluded is None else df.join(excluded, [recipient, parent_id], "left_anti")
    pairs = rows.groupBy(recipient, parent_id, parent_name).agg(F.sum(amount).alias("s"), F.count(F.lit(1)).alias("n"))
    parent = pick_first(pairs, [recipient], [F.col("s").desc_nulls_last(), F.col("n").desc(), F.col(parent_name).asc_nulls_last(), F.col(parent_id).asc_nulls_last()])
    names = pick_first(df.groupBy(recipient, name).agg(F.sum(amount).alias("s")), [recipient], [F.col("s").desc_nulls_last(), F.col(name).asc_nulls_last()])
    x = names.select(recipient, name).join(parent.select(recipient, parent_id, parent_name), recipient, "left")
    family = F.coalesce(parent_name, F.col(parent_id).cast("string"), name, F.col(recipient).cast("string"))
    method = F.when(F.col(parent_name).isNotNull(), "parent_name").when(F.col(parent_id).isNotNull(), "parent_id").when(F.col(name).isNotNull(), "own_name").otherwise("self")
    return x.withColumn("family_key", family).withColumn("method", method)


#: How a client's name is matched with a family, best first.
CLIENT_TIERS = ("exact_family", "curated_alias", "normalized", "family_raw_name", "suffix_residue")


def client_matches(clients: DataFrame, name: str, families: DataFrame, aliases: DataFrame, raw_names: DataFrame) -> DataFrame:
    """(name, family_key, tier): every pair of a filed name and a family that match, by their
    best tier: the normalized name is the family's key; an alias of it; holds it as whole words
    in a row; is a name of one of its members; equals it without words that say nothing. The
    third and fifth ask for two words or four letters.

    ``families`` holds family_key, ``aliases`` and ``raw_names`` family_key and name as written.
    Names are matched once, however many clients file under them; empty names match nothing."""
    filed = clients.select(name).distinct().withColumn("clean", normalize_name(F.col(name))).filter("clean <> ''")
    c = filed.select("clean").distinct().withColumn("words", F.split("clean", " "))
    f = families.select("family_key").filter("family_key <> ''").distinct().withColumn("words", F.split("family_key", " "))
    telling = lambda words: (F.size(words) >= 2) | (F.length(F.get(words, 0)) >= 4)
    known = lambda df: df.select("family_key", normalize_name(F.col("name")).alias("clean")).distinct()
    inside = contiguous_pairs(c, f.filter(telling("words")), []).select(F.col("h_clean").alias("clean"), F.col("n_family_key").alias("family_key"))

    def core(df, key):
        left = df.select(key, F.filter("words", lambda w: ~w.isin(*RESIDUE_WORDS)).alias("core"))
        return left.filter(F.size("core") > 0).filter(telling("core"))

    found = [
        c.join(f.select("family_key"), F.col("clean") == F.col("family_key")),
        c.join(known(aliases), "clean"),
        inside,
        c.join(known(raw_names), "clean"),
        core(c, "clean").join(core(f, "family_key"), "core"),
    ]
    ranked = [df.select("clean", "family_key", F.lit(i).alias("rank")) for i, df in enumerate(found)]
    best = reduce(DataFrame.unionByName, ranked).groupBy("clean", "family_key").agg(F.min("rank").alias("rank"))
    tier = F.element_at(F.array(*map(F.lit, CLIENT_TIERS)), F.col("rank") + 1)
    return filed.join(best, "clean").select(name, "family_key", "rank", tier.alias("tier"))


def best_client_match(clients: DataFrame, name: str, matches: DataFrame) -> DataFrame:
    """``clients`` with the family and tier of their name's best match, of equal ones the
    family first in order; tier 'none' without any."""
    best = matches.groupBy(name).agg(F.min(F.struct("rank", "family_key", "tier")).alias("b")).select(name, "b.family_key", "b.tier")
    return clients.join(best, name, "left").withColumn("tier", F.coalesce("tier", F.lit("none")))


def match_gate(families: DataFrame, total: str, filings: DataFrame, name: str, top: int = 50, floor: float = 0.85) -> DataFrame:
    """One row: of the ``top`` families by ``total``, how many some filing is matched with, how
    many stored matches of tier 'normalized' no longer hold, and whether the gate is passed
    (a share of at least ``floor`` and no such match). ``filings``: ``name``, family_key, tier."""
    matched = filings.filter("tier <> 'none' AND family_key <> ''").select("family_key", F.lit(1).alias("hit")).distinct()
    best = families.orderBy(F.col(total).desc_nulls_last(), "family_key").limit(top)
    counts = best.join(matched, "family_key", "left").agg(F.count(F.lit(1)).alias("top_n"), F.count("hit").alias("matched_count"))
    stored = filings.filter("tier = 'normalized'").select(name, "family_key").distinct()
    bad = stored.filter(~holds_family(normalize_name(F.col(name)), F.col("family_key"))).agg(F.count(F.lit(1)).alias("bad_normalized"))
    share = F.coalesce(F.col("matched_count") / F.nullif("top_n", F.lit(0)), F.lit(0.0))
    both = counts.crossJoin(bad)  # one row each
    return both.select("top_n", "matched_count", F.round(share, 4).alias("matched_fraction"), "bad_normalized", ((share >= floor) & (F.col("bad_normalized") == 0)).alias("ok"))


def cross_parent_downgrade(xwalk: DataFrame, family: str, parent: str, tier: str) -> DataFrame:
    """A family reached from more than one parent is at most medium."""
    many = xwalk.groupBy(family).agg(F.countDistinct(parent).alias("__k"))
    lowered = F.when((F.col("__k") > 1) & (F.col(tier) == "high"), "medium").otherwise(F.col(tier))
    return xwalk.join(many, family).withColumn(tier, lowered).drop("__k")


def first_true(rules: list[tuple[Column, str | Column | None]], default: str | None) -> Column:
    """Label of the first rule that holds."""
    head, *rest = rules
    out = reduce(lambda w, r: w.when(r[0], r[1]), rest, F.when(*head))
    return out.otherwise(default)


def stratified_sample(df: DataFrame, strata: list[str], key: list[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows a stratum, by a hash of seed and key: the same rows every time."""
    order = [F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]), 256), *[F.col(k) for k in key]]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def accounts_match(award: Column, line: Column) -> Column:
    """Unknown award accounts pass; unknown line accounts fail; else one must be shared."""
    unknown = award.isNull() | (F.size(award) == 0)
    known = line.isNotNull() & (F.size(line) > 0)
    return known & (unknown | F.coalesce(F.arrays_overlap(award, line), F.lit(False)))


def review_verdicts(reviews: DataFrame, pair: list[str], row: list[str]) -> tuple[DataFrame, DataFrame]:
    """(verdicts by pair and row, refuted pairs) of review records.

    A record speaks of the article it names; where it names none, or whether the link cites
    it is not known, it binds the link. Records of precision samples refute their pair under
    whatever row, and are no pipeline reviews."""
    rejects, refutes = F.col("reviewer_verdict").isin("weak", "wrong"), F.col("adversarial_verdict") == "refuted"
    binds = (F.trim(F.coalesce("article_id", F.lit(""))) == "") | F.coalesce("cites_article", F.lit(True))
    r = reviews.withColumn("__rejects", F.coalesce(rejects, F.lit(False))).withColumn("__refutes", F.coalesce(refutes, F.lit(False))).withColumn("__binds", binds)
    sampled = F.coalesce(F.col("record_kind") == "precision_sample", F.lit(False))
    some = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    by_row = r.filter(~sampled).groupBy(*pair, *row).agg(
        F.lit(True).alias("reviewed"),
        some((F.col("reviewer_verdict") == "link") & (F.col("adversarial_verdict") == "upheld"), "upheld"),
        some(F.col("__refutes") & F.col("__binds"), "refuted_here"),
        some(F.col("__rejects") & F.col("__binds"), "rejected_here"),
        some(F.col("__refutes"), "refuted"),
        some(F.col("__rejects"), "rejected"),
    )
    by_pair = r.filter(sampled & (F.col("__refutes") | F.col("__rejects"))).select(*pair, F.lit(True).alias("sample_refuted")).distinct()
    return by_row, by_pair


#: What a demotion leaves of a link: all others leave it at medium.
LOW_AFTER = ("account_subagency_not_pinned",)


def overlay_grades(links: DataFrame, adjudications: DataFrame, reviews: DataFrame, rulings: DataFrame, pair: list[str], row: list[str]) -> DataFrame:
    """Links with the decisions of four tables laid over their mechanical ``confidence``.

    Adjudications (one a pair) replace the grade; a ruling of withdrawal, an unpinned
    sub-agency match, matches nobody adjudicated, reviews that did not uphold an
    announcement and refutations by samples only lower it, the first that applies. Adds
    crosswalk_confidence, confidence_source, demotion_reason, award_verdict, pair_reason
    and adjudication_basis; ``confidence`` becomes the final grade. No table multiplies a
    link: each is brought to one row a pair (or pair and row) before its join."""
    by_row, by_pair = review_verdicts(reviews, pair, row)
    withdrawn = rulings.filter(F.col("ruling") == "withdraw").select(*pair, F.lit(True).alias("withdrawn")).distinct()
    a = adjudications.select(*pair, "adjudicated_confidence", "award_verdict", "pair_reason", F.col("basis").alias("adjudication_basis"), "lenses_passed", F.lit(True).alias("adjudicated"))
    j = links.withColumnRenamed("confidence", "crosswalk_confidence").join(a, pair, "left").join(by_row, [*pair, *row], "left").join(by_pair, pair, "left").join(withdrawn, pair, "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    overlaid = F.coalesce("adjudicated_confidence", "crosswalk_confidence")
    pinned = F.coalesce((F.col("award_verdict") == "pinned") & (F.col("pair_reason") == "pinned-here") & (F.col("lenses_passed") == 2), F.lit(False))
    method, high, free = F.col("method"), overlaid == "high", ~is_("adjudicated")
    announced = free & (method == "announcement+lexicon") & high
    shaky = ~is_("upheld") | is_("refuted_here") | is_("rejected_here") | is_("sample_refuted")
    why_shaky = first_true(
        [
            (is_("refuted_here"), "announcement_review_refuted"), (is_("rejected_here"), "announcement_reviewer_rejected"), (is_("upheld"), "precision_sample_refuted"),
            (is_("refuted"), "announcement_review_refuted"), (is_("rejected"), "announcement_reviewer_rejected"), (is_("reviewed"), "announcement_review_incomplete"),
        ],
        "announcement_review_unrecorded",
    )
    reason = first_true(
        [
            (~F.coalesce(overlaid.isin("high", "medium"), F.lit(False)), None),
            (is_("withdrawn") & is_("sample_refuted"), "precision_sample_refuted"),
            (is_("withdrawn"), "line_activity_mismatch"),
            ((method == "account+subagency") & ~pinned, "account_subagency_not_pinned"),
            (free & (method == "account+tokens") & (F.col("crosswalk_confidence") == "high"), "account_tokens_unadjudicated"),
            (announced & shaky, why_shaky),
            (free & high & is_("sample_refuted"), "precision_sample_refuted"),
        ],
        None,
    )
    final = F.when(F.col("demotion_reason").isNull(), overlaid).when(is_("withdrawn") | F.col("demotion_reason").isin(*LOW_AFTER), "low").otherwise("medium")
    source = F.when(is_("adjudicated"), "adjudicated").otherwise("mechanical")
    out = j.withColumn("demotion_reason", reason).withColumn("confidence", final).withColumn("confidence_source", source)
    own = [c for c in links.columns if c != "confidence"]
    return out.select(*own, "confidence", "crosswalk_confidence", "confidence_source", "demotion_reason", "award_verdict", "pair_reason", "adjudication_basis")


def grade_links(lines: DataFrame, transactions: DataFrame, aliases: DataFrame, at_least: int = 2) -> DataFrame:
    """Graded links of lines (code, account, organization, year, words) and awards.

    A candidate award holds the line's account in one of its transactions' account lists,
    in the line's year. ``at_least`` shared words make it high; else a transaction under a
    sub-agency whose name holds an alias of the line's organization makes it medium; else
    the account alone is low. ``matched_obligation`` sums transactions whose whole list is
    the account. ``transactions``: award, year, accounts, words, sub_agency, obligation.

    Awards of one account and year, the same lists of words and the same sub-agencies are of
    a kind and have the same grades: a kind is graded once, and awards are joined with the
    grades of theirs. Awards are written, as they are read for both."""
    t = transactions.select("award", "year", F.explode("accounts").alias("account"), F.size("accounts").alias("n"), "words", "sub_agency", "obligation")
    # One row an award, account and year: what its transactions hold, before any line.
    awards = t.groupBy("award", "account", "year").agg(
        F.sort_array(F.collect_set("words")).alias("word_lists"), F.sort_array(F.collect_set(F.lower("sub_agency"))).alias("agencies"),
        F.sum(F.when(F.col("n") == 1, F.col("obligation"))).alias("matched_obligation"),
    )
    awards = written(awards, "awards")
    kind = ["account", "year", "word_lists", "agencies"]
    known = aliases.groupBy("organization").agg(F.collect_set("alias").alias("aliases"))
    side = lines.groupBy("code", "account", "organization", "year").agg(F.array_distinct(F.flatten(F.collect_set("words"))).alias("line_words")).join(F.broadcast(known), "organization", "left")
    j = awards.select(*kind).distinct().withColumn("award_words", F.array_distinct(F.flatten("word_lists"))).join(side, ["account", "year"])
    shared = F.size(F.array_intersect("award_words", "line_words"))
    under = F.exists("agencies", lambda s: F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(s, a)))
    rules = [(shared >= at_least, "account+tokens"), (under, "account+subagency")]
    j = j.withColumn("method", first_true(rules, "account")).withColumn("overlap", shared)
    grade = first_true([(F.col("method") == "account+tokens", "high"), (F.col("method") == "account+subagency", "medium")], "low")
    grades = j.select(*kind, "code", "organization", grade.alias("confidence"), "method", "overlap")
    return awards.join(grades.hint("merge"), kind).select("code", "account", "organization", "year", "award", "confidence", "method", "overlap", "matched_obligation")


#: Sums under this many thousands count as continuous whatever they are.
CONTINUITY_FLOOR = 1000


def continuity(amounts: DataFrame, ident: list[str]) -> DataFrame:
    """(``ident``, passed, total): years in which both an enacted sum and the actuals of that
    year are known, and those in which they are of one sign and within a factor of two, or
    both small. ``amounts``: ident, fy, kind ('enacted' or 'actuals'), amount."""
    y = amounts.groupBy(*ident, "fy").agg(*[F.sum(F.when(F.col("kind") == k, F.col("amount"))).alias(k) for k in ("enacted", "actuals")])
    y = y.filter("enacted IS NOT NULL AND actuals IS NOT NULL")
    high, low = F.greatest(F.abs("enacted"), F.abs("actuals")), F.least(F.abs("enacted"), F.abs("actuals"))
    good = (high < CONTINUITY_FLOOR) | ((low * 2 >= high) & ((F.col("enacted") >= 0) == (F.col("actuals") >= 0)))
    return y.groupBy(*ident).agg(F.count_if(good).alias("passed"), F.count(F.lit(1)).alias("total"))


def classify_era_keys(era: DataFrame, modern: DataFrame, amounts: DataFrame, resolution_codes: list[str], alike: float = 0.5) -> DataFrame:
    """``era`` (edition, account, code, title) with its ``class`` against ``modern`` (same columns).

    CR: a continuing resolution's code. An identity (account, code) that modern editions
    have is R3 where its edition filed the code under several accounts, unless modern ones
    do so too; A1 by a title of theirs; A2 by an alike title and amounts that go on in two
    thirds of the years; else R1. A code that they have under another account only is R2,
    one that they lack H. The title nearest to the key is taken, and two titles of an
    identity never make two rows."""
    ident = ["account", "code"]
    titles = modern.groupBy(*ident).agg(F.collect_set(normalize_title(F.col("title"))).alias("__titles"))
    several = lambda df, by, name: df.groupBy(*by).agg((F.countDistinct("account") > 1).alias(name))
    j = era.join(titles, ident, "left").join(continuity(amounts, ident), ident, "left")
    j = j.join(several(era, ["edition", "code"], "__split_then"), ["edition", "code"]).join(several(modern, ["code"], "__split_now"), "code", "left")
    best = F.coalesce(F.array_max(F.transform("__titles", lambda t: title_jaccard(F.col("title"), t))), F.lit(0.0))
    known = F.col("__titles").isNotNull()
    goes_on = F.coalesce((F.col("total") > 0) & (F.col("passed") * 3 >= F.col("total") * 2), F.lit(False))
    rules = [
        (F.col("code").isin(resolution_codes), "CR"),
        (known & F.col("__split_then") & ~F.col("__split_now"), "R3"),
        (known & F.array_contains("__titles", normalize_title(F.col("title"))), "A1"),
        (known & (best >= alike) & goes_on, "A2"),
        (known, "R1"),
        (F.col("__split_now").isNotNull(), "R2"),
    ]
    return j.select(*era.columns, first_true(rules, "H").alias("class"))
