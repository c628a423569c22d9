"""Rules over the clauses of program narratives: stated lineage edges, clauses that may
state one, successors of vanished codes, and terms that stand in titles.

Clauses are arrays inside a row until a rule has found something in them, so texts are
neither exploded nor shuffled; what is shuffled are the findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purselake.operators.windows import pick_first

# A clause ends at a colon or at a period that is no decimal point; codes;
# the cues of each rule, in their order, and what an edge found by them is called.
CLAUSE_END = r":|(?<![0-9])\.|\.(?![0-9])"
CODE = "[0-9]{7}(?:[A-Za-z][A-Za-z0-9]{0,3})?"
NAMED_CODE = rf"(?:pe|program element)\s+({CODE})"
FROM_CUES = (
    (r"transferred?\s+from", "realigned"),
    (r"realign\w*\s+from", "realigned"),
    (r"previously\s+(?:funded|budgeted)\s+(?:in|under)", "renamed"),
    (r"formerly", "renamed"),
)
TO_CUES = ((r"transferred?\s+to", "realigned"), (r"realign\w*\s+to", "realigned"))
SUBJECT_RELATION = "realigned"
NEGATIONS = ("erroneously", "in error", "incorrectly", "realigned back", "transferred back", "will be returned", "rescinded")
MOVES = (
    r"transferr?ed?", r"transfers?", r"realign\w*", r"formerly", r"previously (?:funded|budgeted)", r"renamed", r"migrat\w*", r"moved", r"consolidat\w*", r"merged", r"split",
    r"restructur\w*",
)
CONTINUATIONS = ("continuation of", "continues under", "previously funded under", "previously funded in", "previously reflected under", "previously reflected in")
CODE_SIGNS = "[A-Z0-9]{5,}"
ACCOUNT_PREFIX = "^[0-9]{4}(?=[A-Z])"

ACRONYM = r"\b[A-Z][A-Za-z0-9&/.-]*(?:[ -][A-Z0-9][A-Za-z0-9&/.-]*){1,7}\s+\([A-Z]{2,10}[0-9]{0,3}\)"
DESIGNATOR = r"\b(?:AN/[A-Z]{3}-[0-9]{1,3}[A-Z]?|[A-Z]{1,4}-[0-9]{1,4}[A-Z]?|(?:DDG|CVN|SSN|SSBN|LPD|LHA|LCS|FFG|T-AO)\s?[0-9]{2,4})\b"
TITLE_JUNK = r"(?i)^(?:accomplishments|plans|title|description|articulat|congressional|program change|other program funding|acquisition strategy|performance metrics|n/a|none)\b"
SYNTHETIC = "-L[0-9]+$"

#: What stands before the last "moved to <code>" of a clause; its own codes are subjects.
BEFORE_LAST_TO = rf"(?is)^(.*)(?:transferred?|realign\w*)\s+to\s+(?:pe|program element)\s+[0-9]"
SUBJECT = rf"(?i)(?:(?:to|from)\s+)?{NAMED_CODE}"


def clause_rows(narratives: DataFrame, keys: list[str], body: str, wanted: str) -> DataFrame:
    """(``keys``, clause_no, clause, before, after): the clauses that match ``wanted``, with
    their neighbours. Blank clauses do not count."""
    parts = F.filter(F.split(F.coalesce(F.col(body), F.lit("")), CLAUSE_END), lambda c: c.rlike(r"[^ \t\r\n]"))
    rows = narratives.select(*keys, parts.alias("__parts"))
    beside = F.transform("__parts", lambda c, i: F.struct((i + 1).alias("clause_no"), c.alias("clause"), F.when(i > 0, F.get("__parts", i - 1)).alias("before"), F.get("__parts", i + 1).alias("after")))
    return rows.select(*keys, F.explode(F.filter(beside, lambda c: c["clause"].rlike(wanted))).alias("c")).select(*keys, "c.*")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def found_codes(clause: Column, pattern: str, relation: str) -> Column:
    return F.transform(F.regexp_extract_all(clause, F.lit(pattern), F.lit(1)), lambda x: F.struct(x.alias("code"), F.lit(relation).alias("relation")))


def first_of_each(found: Column) -> Column:
    """The first entry of each code."""
    codes = F.transform(found, lambda x: x["code"])
    return F.filter(found, lambda x, i: F.array_position(codes, x["code"]) == i + 1)


def clause_edges(clause: Column, own: Column) -> Column:
    """Edges (from_code, to_code, relation) of one clause, in the rules' order.

    A clause that names both ends states those pairs alone, and a rename yields the other
    side's relation; otherwise the narrative's own code is the end not named.
    """
    subjects = F.regexp_extract_all(F.regexp_extract(clause, BEFORE_LAST_TO, 1), F.lit(SUBJECT), F.lit(0))
    subjects = F.transform(F.filter(subjects, lambda s: ~s.rlike(r"(?i)^(?:to|from)\s")), lambda s: F.struct(F.regexp_extract(s, f"({CODE})$", 1).alias("code"), F.lit(SUBJECT_RELATION).alias("relation")))
    sources = F.concat(*[found_codes(clause, rf"(?i){cue}\s+{NAMED_CODE}", relation) for cue, relation in FROM_CUES], subjects)
    targets = F.concat(*[found_codes(clause, rf"(?i){cue}\s+{NAMED_CODE}", relation) for cue, relation in TO_CUES])
    edge = lambda a, b, relation: F.struct(a.alias("from_code"), b.alias("to_code"), relation.alias("relation"))
    relation = lambda s, t: F.when(s["relation"] != "renamed", s["relation"]).otherwise(t["relation"])
    crossed = F.transform(first_of_each(sources), lambda s: F.transform(first_of_each(targets), lambda t: edge(s["code"], t["code"], relation(s, t))))
    both = F.filter(F.flatten(crossed), lambda e: e["from_code"] != e["to_code"])
    one = F.concat(F.transform(sources, lambda s: edge(s["code"], own, s["relation"])), F.transform(targets, lambda t: edge(own, t["code"], t["relation"])))
    return F.when(F.size(both) > 0, both).otherwise(F.filter(one, lambda e: e["from_code"] != e["to_code"]))


def names_code(text: Column, code: Column) -> Column:
    return F.array_contains(F.split(text, "[^A-Za-z0-9]+"), code)


def stated_edges(narratives: DataFrame, id_: str, own: str, year: str, body: str) -> DataFrame:
    """One row a pair (from_code, to_code): the telling of the latest edition, then of the
    first narrative, clause and rule; with ``edge_id`` and the clause as evidence.

    A cue of retraction in the clause takes its edges away; one in the clause after it only
    those that it names an end of.
    """
    any_cue = "|".join(cue for cue, _ in (*FROM_CUES, *TO_CUES))
    c = clause_rows(narratives, [id_, own, year], body, rf"(?i)(?:{any_cue})\s+(?:pe|program element)\s")
    e = c.select("*", F.posexplode(clause_edges(F.col("clause"), F.col(own)))).select("*", "col.*").drop("col")
    retracts = lambda col: F.coalesce(F.lower(col).rlike("|".join(NEGATIONS)), F.lit(False))
    named = F.coalesce(names_code(F.col("after"), F.col("from_code")) | names_code(F.col("after"), F.col("to_code")), F.lit(False))
    e = e.filter(~retracts(F.col("clause")) & ~(retracts(F.col("after")) & named))
    e = pick_first(e, ["from_code", "to_code"], [F.col(year).desc(), F.col(id_), F.col("clause_no"), F.col("pos")])
    evidence = trimmed(F.col("clause"))
    digest = F.sha2(F.concat_ws("|", "from_code", "to_code", F.col(year).cast("string"), "relation", evidence), 256)
    return e.select("from_code", "to_code", "relation", year, id_, "clause_no", F.substring(digest, 1, 16).alias("edge_id"), evidence.alias("evidence"))


def clause_candidates(narratives: DataFrame, id_: str, body: str) -> DataFrame:
    """Clauses with a verb of moving and at least one code: sorted codes, neighbours and an
    id of narrative and clause; the first of each id."""
    c = clause_rows(narratives, [id_], body, rf"(?i)\b(?:{'|'.join(MOVES)})\b")
    words = F.regexp_extract_all("clause", F.lit("[A-Za-z0-9]+"), F.lit(0))
    codes = F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike("^[0-9]{7}(?:[A-Z][A-Z0-9]{0,3})?$"))))
    c = c.withColumn("codes", codes).filter(F.size("codes") > 0)
    clause = trimmed(F.col("clause"))
    c = c.withColumn("clause_id", F.substring(F.sha2(F.concat_ws("|", F.col(id_).cast("string"), clause), 256), 1, 16))
    c = pick_first(c, ["clause_id"], [F.col(id_), F.col("clause_no")])
    near = lambda n: F.coalesce(trimmed(F.col(n)), F.lit("")).alias(n)
    return c.select("clause_id", id_, "clause_no", clause.alias("clause"), near("before"), near("after"), F.array_join("codes", ",").alias("codes"))


def occurrences(text: Column, pattern: str) -> Column:
    """Matches of a pattern: (place, found), places in characters from 0. Letters beyond ASCII
    count as gaps."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", " ")
    found, between = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)), F.split(plain, pattern)
    length = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    return F.transform(found, lambda x, i: F.struct((length(F.slice(between, F.lit(1), i + 1)) + length(F.slice(found, F.lit(1), i))).alias("place"), x.alias("found")))


def lexicon_candidates(narratives: DataFrame, key: str, id_: str, title: str, body: str, quotes: int = 3) -> DataFrame:
    """(key, name, source, n, quote, id_): names that a program goes by, each with its first
    ``quotes`` quotations: titles, acronyms and what they stand for, and designators of
    titles and bodies. Titles that name a section of the book and synthetic keys are left
    out, and so are names under 3 and over 90 characters."""
    b, t = F.coalesce(F.col(body), F.lit("")), F.trim(F.coalesce(F.col(title), F.lit("")))
    entry = lambda name, source, quote: F.struct(name.alias("name"), F.lit(source).alias("source"), quote.alias("quote"))

    def around(o: Column, reach: int) -> Column:
        start = F.greatest(o["place"] - reach, F.lit(0))
        return F.substring(b, start + 1, o["place"] + F.length(o["found"]) + reach - start)

    good = (t != "") & ~t.rlike(TITLE_JUNK)
    none = F.array().cast("array<struct<name:string,source:string,quote:string>>")
    of_title = F.when(good, F.concat(F.array(entry(t, "title", t)), F.transform(occurrences(t, DESIGNATOR), lambda o: entry(o["found"], "designator-title", t)))).otherwise(none)
    acronyms = occurrences(b, ACRONYM)
    short = lambda o: F.regexp_extract(o["found"], r"\(([A-Z0-9]+)\)$", 1)
    of_acronyms = F.flatten(F.transform(acronyms, lambda o: F.array(entry(o["found"], "acronym-def", around(o, 60)), entry(short(o), "acronym", around(o, 60)))))
    of_body = F.transform(occurrences(b, DESIGNATOR), lambda o: entry(o["found"], "designator-body", around(o, 90)))
    rows = narratives.filter(F.col(key).isNotNull() & ~F.col(key).rlike(SYNTHETIC)).select(key, id_, F.posexplode(F.concat(of_title, of_acronyms, of_body))).select(key, id_, "pos", "col.*")
    rows = rows.withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " "))).filter(F.length("name").between(3, 90))
    order = Window.partitionBy(key, F.lower("name")).orderBy(id_, "pos")
    rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= quotes)
    return rows.select(key, "name", "source", "n", F.substring("quote", 1, 220).alias("quote"), id_)


def code_forms(codes: DataFrame, code: str) -> DataFrame:
    """``codes`` once for each form (``token``, ``form``): as filed, and without the
    account's four digits where at least five signs stay."""
    short = F.regexp_replace(F.col(code), ACCOUNT_PREFIX, "")
    forms = F.filter(F.array(F.struct(F.col(code).alias("token"), F.lit("literal").alias("form")), F.struct(short.alias("token"), F.lit("short").alias("form"))), lambda f: (f["form"] == "literal") | ((short != F.col(code)) & (F.length(short) >= 5)))
    return codes.select("*", forms.alias("own_forms")).select("*", F.explode("own_forms").alias("f")).select(*codes.columns, F.transform("own_forms", lambda f: f["token"]).alias("own"), "f.token", "f.form")


def successors(vanished: DataFrame, current: DataFrame, narratives: DataFrame, id_: str, year: str, body: str) -> DataFrame:
    """One row a vanished code (code, account) that a clause with a wording of continuation
    names beside exactly one current code; those of the vanished code's account go first.

    Clauses are read from the latest edition on, and a code's literal form beats its short
    one wherever it stands.
    """
    c = clause_rows(narratives, [id_, year], body, rf"(?i)(?:{'|'.join(CONTINUATIONS)})")
    words = F.array_distinct(F.regexp_extract_all("clause", F.lit(rf"\b{CODE_SIGNS}\b"), F.lit(0)))
    tokens = F.filter(words, lambda w: w.rlike("[A-Z]") & w.rlike("[0-9]"))
    at = [id_, year, "clause_no"]
    t = c.select(*at, F.explode(tokens).alias("token"))
    old = t.join(code_forms(vanished, "code"), "token")
    new = t.join(code_forms(current.distinct(), "code"), "token").select(*at, F.col("token").alias("other"), F.struct(F.col("code").alias("code"), F.col("account").alias("account")).alias("new"))
    j = old.join(new, at).filter(~F.array_contains("own", F.col("other")))
    same = F.when(F.col("new.account") == F.col("account"), F.col("new"))
    g = j.groupBy(*at, "code", "account", "form", "token").agg(F.min("new").alias("lo"), F.max("new").alias("hi"), F.min(same).alias("same_lo"), F.max(same).alias("same_hi"))
    pick = F.when(F.col("same_lo").isNotNull(), F.when(F.col("same_lo") == F.col("same_hi"), F.col("same_lo"))).when(F.col("lo") == F.col("hi"), F.col("lo"))
    g = g.withColumn("pick", pick).filter("pick IS NOT NULL")
    order = [(F.col("form") == "literal").desc(), F.col(year).desc(), F.col(id_), F.col("clause_no"), F.col("token")]
    best = pick_first(g, ["code", "account"], order)
    return best.select("code", "account", F.col("pick.code").alias("successor_code"), F.col("pick.account").alias("successor_account"), F.col("form").alias("matched_form"), id_, "clause_no")


def word_list(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def contiguous_pairs(hay: DataFrame, needle: DataFrame, keys: list[str], at_least: int = 1) -> DataFrame:
    """Rows of ``needle`` (``words``) that stand, in order and without gaps, in the words of
    a row of ``hay`` (``words``) of equal ``keys``; needles of at least ``at_least`` words.

    An inverted index of both sides: a needle is looked up by its word that fewest rows of
    ``hay`` hold, so the join makes few pairs more than it returns. Exploded words are many
    times the size that Spark estimates for them, so the joins are told not to broadcast.
    """
    h = hay.select(*[F.col(c).alias(f"h_{c}") if c not in keys else F.col(c) for c in hay.columns])
    h = h.withColumn("word", F.explode(F.array_distinct("h_words")))
    n = needle.filter(F.size("words") >= max(1, at_least)).select(*[F.col(c).alias(f"n_{c}") if c not in keys else F.col(c) for c in needle.columns])
    seen = h.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("rows"))
    others = [c for c in n.columns]
    asked = n.select("*", F.explode(F.array_distinct("n_words")).alias("word")).join(seen.hint("merge"), [*keys, "word"], "left")
    # A word that no row holds leaves its needle without any pair.
    rarest = asked.groupBy(*others).agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "word")).alias("r")).filter("r.rows > 0")
    rarest = rarest.select(*others, F.col("r.word").alias("word"))
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return h.join(rarest.hint("merge"), [*keys, "word"]).filter(F.contains(padded("h_words"), padded("n_words"))).drop("word")


def assessment_candidates(programs: DataFrame, assessments: DataFrame, org: str, title: str, id_: str, names: list[str], at_least: int = 3) -> DataFrame:
    """(id_, org, title, term, rule): rule A where a term of an assessment (``names``, the
    part in trailing parentheses left out) stands in a program's title, rule B where a title
    of at least ``at_least`` words stands in a term and A does not hold. Both of one ``org``.
    Terms are matched once, however many assessments go by them."""
    clean = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s*\([^()]*\)\s*$", ""))
    named = assessments.select(id_, org, F.explode(F.array_distinct(F.array(*map(clean, names)))).alias("term")).filter("term <> ''").distinct()
    terms = named.select(org, "term").distinct().withColumn("words", word_list(F.col("term")))
    titles = programs.select(org, title).distinct().withColumn("words", word_list(F.col(title)))
    a = contiguous_pairs(titles, terms, [org]).select(org, F.col(f"h_{title}").alias(title), F.col("n_term").alias("term"), F.lit("A").alias("rule"))
    b = contiguous_pairs(terms, titles, [org], at_least).select(org, F.col(f"n_{title}").alias(title), F.col("h_term").alias("term"), F.lit("B").alias("rule"))
    pairs = a.unionByName(b).groupBy(org, title, "term").agg(F.min("rule").alias("rule"))
    return named.join(pairs.hint("merge"), [org, "term"]).select(id_, org, title, "term", "rule")
