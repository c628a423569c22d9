"""The domain's tables, bound to the TPC-H-like tables of a folder.

Each binding exists twice: as a DataFrame and, in ``SQL``, as a common table
expression that the oracle queries start from. Money is decimal, so sums do not
depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purselake.functions import exprs as X


class Lake:
    """Tables of one folder, read lazily; each is a plain parquet scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)  # its schema is read once
        return table

    def transactions(self, with_order: bool = True) -> DataFrame:
        """Award transactions: lineitem with its order's date-free columns. Each line item
        has its one order, so jobs that need none of its columns leave the join out."""
        money = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount")).cast("decimal(4,2)")
        signed = F.when(F.col("l_returnflag") == "R", -money).otherwise(money).cast("decimal(24,4)")
        rows, of_order = self.lineitem, []
        if with_order:
            rows = rows.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            of_order = [F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("sub_agency")]
        return rows.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_key"),
            F.when(F.col("l_linestatus") == "O", "contract").otherwise("assistance").alias("award_type"),
            F.col("l_shipdate").cast("date").alias("action_date"),
            X.federal_fiscal_year(F.col("l_shipdate")).alias("fiscal_year"),
            signed.alias("obligation"),
            F.col("l_orderkey").alias("award_id"),
            F.col("l_suppkey").alias("recipient_id"),
            F.col("l_partkey").alias("part_id"),
            *of_order,
            F.col("l_quantity").alias("quantity"),
        )

    def recipients(self) -> DataFrame:
        """Entity crosswalk: recipient, name, family (nation), parent (region)."""
        s, n, r = self.supplier, self.nation, self.region
        return (
            s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
            .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("recipient_id"), F.col("s_name").alias("recipient_name"), F.col("n_name").alias("family_key"), F.col("r_name").alias("parent_name"), F.col("s_acctbal").alias("balance"))
        )

    def places(self) -> DataFrame:
        """customer -> state (region) and district (nation)."""
        c, n, r = self.customer, self.nation, self.region
        return (
            c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.col("c_custkey").alias("customer_id"), F.col("r_name").alias("pop_state"), F.col("n_name").alias("pop_district"))
        )

    def located(self) -> DataFrame:
        return self.transactions().join(self.places(), "customer_id")

    def family_transactions(self, with_order: bool = True) -> DataFrame:
        return self.transactions(with_order).join(self.recipients(), "recipient_id", "left")

    def lines(self) -> DataFrame:
        """Budget lines: code, account, organization, edition, amount type, amount."""
        p = self.part
        edition = F.col("p_size") % 10 + 2017
        kind = F.col("p_partkey") % 3
        book = F.floor(F.col("p_partkey") / 3) % 3
        slug = F.when(kind == 0, F.concat(F.lit("fy_"), (edition - 2).cast("string"), F.lit("_actuals")))
        slug = slug.when(kind == 1, F.concat(F.lit("fy_"), (edition - 1).cast("string"), F.lit("_total"))).otherwise(F.concat(F.lit("fy_"), edition.cast("string"), F.lit("_request")))
        return p.select(
            F.col("p_partkey").alias("line_id"),
            F.col("p_brand").alias("pe_bli"),
            F.col("p_type").alias("account"),
            F.substring("p_name", 1, 1).alias("organization"),
            edition.cast("int").alias("edition_year"),
            slug.alias("amount_type"),
            F.col("p_name").alias("title"),
            F.when(book == 0, "R-1").when(book == 1, "P-1").otherwise("P-1R").alias("exhibit"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("amount_thousands"),
        )

    def links(self) -> DataFrame:
        """Graded links: (code, award) pairs with a tier by quantity."""
        li, p = self.lineitem, self.part.select("p_partkey", "p_brand")
        tier = F.max(F.when(F.col("l_quantity") >= 40, 3).when(F.col("l_quantity") >= 20, 2).otherwise(1))
        grouped = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("pe_bli"), F.col("l_orderkey").alias("award_id")).agg(tier.alias("rank"))
        return grouped.select("pe_bli", "award_id", F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").otherwise("low").alias("confidence"))

    def award_links(self) -> DataFrame:
        """Links of program codes and awards as found, with method, exhibit and year."""
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("pe_bli"), F.col("l_orderkey").alias("award_id")).agg(*[F.expr(e).alias(c) for c, e in LINK_COLUMNS.items()])

    def link_decisions(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Adjudications, review records and rulings about links."""
        li = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        pairs = self.award_links()
        of = li.select(F.col("p_brand").alias("pe_bli"), F.col("l_orderkey").alias("award_id"), *[F.expr(e).alias(c) for c, e in REVIEW_COLUMNS.items()], "l_linenumber").filter("l_linenumber >= 4").drop("l_linenumber")
        reviews = of.join(pairs.select("pe_bli", "award_id", "exhibit", "fiscal_year"), ["pe_bli", "award_id"])
        o = pairs.select("pe_bli", "award_id").join(self.orders, F.col("award_id") == F.col("o_orderkey"))
        adjudications = o.filter(ADJUDICATED).select("pe_bli", "award_id", *[F.expr(e).alias(c) for c, e in ADJUDICATION_COLUMNS.items()])
        rulings = o.filter("o_orderpriority = '3-MEDIUM' AND o_totalprice < 250000").select("pe_bli", "award_id", F.expr("CASE o_orderstatus WHEN 'F' THEN 'withdraw' WHEN 'P' THEN 'hold' ELSE 'allow' END").alias("ruling"))
        return adjudications, reviews, rulings

    def announcements(self) -> DataFrame:
        """Announcement pages, one an order."""
        return self.orders.select(F.col("o_orderkey").alias("page_id"), F.expr(ANNOUNCEMENT).alias("html"))

    def filings(self) -> DataFrame:
        """Filings: registrant, quarter, type and string amounts from orders."""
        o = self.orders
        return o.select(
            F.col("o_orderkey").alias("filing_id"),
            F.col("o_custkey").alias("registrant"),
            F.year("o_orderdate").alias("filing_year"),
            F.quarter("o_orderdate").alias("filing_period"),
            F.when(F.col("o_orderstatus") == "F", "RR").when(F.col("o_orderstatus") == "P", "1A").otherwise("Q1").alias("filing_type"),
            F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("income_usd"),
        )


    def narratives(self) -> DataFrame:
        """Program narratives: each document's text and a closing passage about codes. Two
        documents tell of the same codes, in editions and wordings of their own."""
        codes = {c: F.expr(e) for c, e in NARRATIVE_CODES.items()}
        d = self.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[e.alias(c) for c, e in codes.items()])
        year = (2017 + F.col("doc_id") % 9).cast("int")
        return d.select(F.col("doc_id").alias("narrative_id"), F.col("own").alias("pe_code"), year.alias("fiscal_year"), F.concat("text", F.lit(". "), F.expr(PASSAGE)).alias("body"), F.expr(TITLE).alias("title"), F.expr(LEXICON_KEY).alias("lexicon_key"))

    def items(self) -> DataFrame:
        """Line items: a code as filed, some with their account's four digits before it."""
        return self.part.select(F.expr(ITEM_CODE.format("p_partkey")).alias("code"), F.col("p_type").alias("account"), (F.col("p_size") % 10 + 2017).cast("int").alias("edition_year"))


def _code(number: str) -> str:
    return f"concat(lpad(CAST(600000 + {number} AS STRING), 7, '0'), 'F')"


# Expressions that Spark and the oracle read alike.
NARRATIVE_CODES = {"own": _code("doc_id"), "one": _code("CAST(floor(doc_id / 2) AS INT) + 7"), "two": _code("CAST(floor(doc_id / 2) AS INT) + 11")}
ITEM_CODE = "concat(CASE WHEN {0} % 3 = 0 THEN '5600' ELSE '' END, substr('ABCDEFGH', 1 + CAST({0} % 8 AS INT), 1), lpad(CAST({0} AS STRING), 5, '0'))"
SHORT_CODE = "concat(substr('ABCDEFGH', 1 + CAST({0} % 8 AS INT), 1), lpad(CAST({0} AS STRING), 5, '0'))"
_ITEM = {f"item{i}": ITEM_CODE.format(f"((doc_id + {i}) % 200)") for i in (0, 1, 2, 40)} | {"short0": SHORT_CODE.format("(doc_id % 200)")}
#: A closing passage by the document's number; ``{name}`` is a code.
_PASSAGES = [
    "Funding was transferred from PE {one} in FY 2020. The total is $62.4M. Line {item0} continues under {item1}.",
    "Efforts were realigned to program element {one}: see the summary. It is a continuation of {short0} now {item2}.",
    "This work was previously funded under PE {one} at $1.5 million and {item0} was previously funded in {item1} and {item2}.",
    "Formerly PE {one}. The line {item0} continues under {item40} or {item1}.",
    "In PE {one} F-phase, efforts were transferred to PE {two} for $12.5 million. The Joint Strike Program (JSP2) buys F-35A and DDG 51 spares.",
    "Funds were erroneously transferred to PE {one}. Line {item0} is listed beside {item1}.",
    "Funds were transferred to PE {one}. The transfer to {one} was rescinded in FY 2021. {short0} previously reflected in {item1}.",
    "Funds were transferred to PE {one}. Another award was rescinded. Sea Based Radar Suite  (SBRS) with AN/TPY-2 and é-22 F-22.",
    "Work transferred from PE {one} and transferred to PE {two}. It moved; {item0} is a continuation of {item40}.",
    "Previously budgeted in PE {one}, it was realigned to PE {two}. Merged with 0601234 and split.",
]


def _passage(template: str) -> str:
    parts = [x for piece in template.split("{") for x in ((piece,) if "}" not in piece else (None, *piece.split("}", 1)))]
    out, it = [], iter(parts)
    for x in it:
        out.append((NARRATIVE_CODES | _ITEM)[next(it)] if x is None else f"'{x}'")
    return f"concat({', '.join(x for x in out if x != chr(39) * 2)})"


PASSAGE = "CASE CAST(doc_id % 10 AS INT) " + " ".join(f"WHEN {i} THEN {_passage(t)}" for i, t in enumerate(_PASSAGES)) + " ELSE '' END"


def _number(prefix: str, key: str) -> str:
    digits = 6 - len(prefix)
    return f"concat('{prefix}', lpad(CAST({key} % {10**digits} AS STRING), {digits}, '0'), '-', lpad(CAST(o_custkey % 100 AS STRING), 2, '0'), '-C-', lpad(CAST({key} % 10000 AS STRING), 4, '0'))"


_CENTS = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
ANNOUNCEMENT = f"""concat('<html><title>Contracts For ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INT), 3), '. ', CAST(day(o_orderdate) AS STRING), ', ', CAST(year(o_orderdate) AS STRING),
 '</title><p>ARMY</p><p class="x"><b>Supplier ', CAST(o_custkey AS STRING), ' Inc.,</b> Springfield, was awarded a $', {_CENTS}, ' contract (', {_number('W', 'o_orderkey')}, ') for widgets.</p><p></p><P>*Customer, Dayton, won a $', CAST(o_custkey AS STRING), '.25 million modification to contract ',
 {_number('FA', 'o_custkey')}, ' and ', {_number('N', 'o_orderkey')}, ', of $1,250,000, $2 billion, $', CAST(o_orderkey AS STRING), ' and $7.</P><p>No number here, $5 million.</p><p>', CASE WHEN o_orderstatus = 'F' THEN 'U.S. Transportation Command.' ELSE 'The army of words' END,
 ' **</p><p>Depot ', o_orderpriority, ' took ', {_number('SP', 'o_orderkey')}, '.</p></html>')"""
LINK_COLUMNS = {
    "exhibit": "CASE WHEN max(p_size) >= 25 THEN 'R-1' ELSE 'P-1' END",
    "fiscal_year": "CAST(min(year(l_shipdate)) AS INT)",
    "organization": "min(substr(p_name, 1, 1))",
    "recipient_id": "min(l_suppkey)",
    "method": "CASE WHEN max(l_tax) >= 0.07 THEN 'announcement+lexicon' WHEN max(l_quantity) >= 40 THEN 'account+tokens' WHEN max(l_quantity) >= 20 THEN 'account+subagency' ELSE 'account' END",
    "account": "min(p_type)",
    "confidence": "CASE WHEN max(l_tax) >= 0.07 OR max(l_quantity) >= 35 THEN 'high' WHEN max(l_quantity) >= 20 THEN 'medium' ELSE 'low' END",
}
REVIEW_COLUMNS = {
    "record_kind": "CASE WHEN l_discount >= 0.09 THEN 'precision_sample' ELSE 'pipeline' END",
    "reviewer_verdict": "CASE l_returnflag WHEN 'N' THEN 'link' WHEN 'A' THEN 'weak' ELSE 'wrong' END",
    "adversarial_verdict": "CASE WHEN l_quantity <= 8 THEN NULL WHEN l_linestatus = 'O' THEN 'upheld' ELSE 'refuted' END",
    "article_id": "CASE WHEN l_tax < 0.02 THEN ' ' ELSE CAST(CAST(l_tax * 100 AS INT) AS STRING) END",
    "cites_article": "CASE WHEN l_quantity > 30 THEN TRUE WHEN l_quantity > 15 THEN FALSE END",
}
ADJUDICATED = "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 60000"
ADJUDICATION_COLUMNS = {
    "adjudicated_confidence": "CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 150000 THEN 'medium' ELSE 'low' END",
    "award_verdict": "CASE o_orderpriority WHEN '1-URGENT' THEN 'pinned' ELSE 'plausible' END",
    "pair_reason": "CASE WHEN o_orderstatus = 'F' THEN 'pinned-here' ELSE 'pinned-elsewhere' END",
    "basis": "concat('order ', CAST(o_orderkey AS STRING))",
    "lenses_passed": "CASE WHEN o_totalprice > 200000 THEN 2 ELSE 1 END",
}


TITLE = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'Program Change Summary' WHEN 1 THEN 'n/a' WHEN 2 THEN concat('Advanced Radar AN/SPY-', CAST(doc_id % 30 + 1 AS STRING)) WHEN 3 THEN concat('  Mission   System ', CAST(doc_id % 40 AS STRING)) END"
LEXICON_KEY = f"CASE WHEN doc_id % 13 = 0 THEN concat('ARMY-A-L', CAST(doc_id AS STRING)) ELSE {_code('CAST(floor(doc_id / 40) AS INT)')} END"
SQL = {
    "al": f"""al AS (SELECT p_brand AS pe_bli, l_orderkey AS award_id, {', '.join(f'{e} AS {c}' for c, e in LINK_COLUMNS.items())} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
adj AS (SELECT pe_bli, award_id, {', '.join(f'{e} AS {c}' for c, e in ADJUDICATION_COLUMNS.items())} FROM al JOIN orders ON award_id = o_orderkey WHERE {ADJUDICATED}),
rev AS (SELECT r.*, exhibit, fiscal_year FROM (SELECT p_brand AS pe_bli, l_orderkey AS award_id, {', '.join(f'{e} AS {c}' for c, e in REVIEW_COLUMNS.items())} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber >= 4) r JOIN al USING (pe_bli, award_id)),
rul AS (SELECT pe_bli, award_id, CASE o_orderstatus WHEN 'F' THEN 'withdraw' WHEN 'P' THEN 'hold' ELSE 'allow' END AS ruling FROM al JOIN orders ON award_id = o_orderkey WHERE o_orderpriority = '3-MEDIUM' AND o_totalprice < 250000)""",
    "an": f"""an AS (SELECT o_orderkey AS page_id, {ANNOUNCEMENT} AS html FROM orders)""",
    "nv": f"""nv AS (
  SELECT doc_id AS narrative_id, {NARRATIVE_CODES['own']} AS pe_code, CAST(2017 + doc_id % 9 AS INTEGER) AS fiscal_year, concat(coalesce(text, ''), '. ', {PASSAGE}) AS body, {TITLE} AS title, {LEXICON_KEY} AS lexicon_key
  FROM documents)""",
    "it": f"""it AS (SELECT {ITEM_CODE.format('p_partkey')} AS code, p_type AS account, CAST(p_size % 10 + 2017 AS INTEGER) AS edition_year FROM part)""",
    # Clauses: inner points of numbers are hidden while the body is split.
    "nc": """nc AS (SELECT narrative_id, pe_code, fiscal_year, clause, CAST(clause_no AS INTEGER) AS clause_no, lag(clause) OVER w AS "before", lead(clause) OVER w AS "after" FROM (
    SELECT narrative_id, pe_code, fiscal_year, unnest(parts) AS clause, generate_subscripts(parts, 1) AS clause_no FROM (
      SELECT narrative_id, pe_code, fiscal_year, [replace(c, chr(57344), '.') FOR c IN string_split_regex(
        regexp_replace(regexp_replace(body, '([0-9])\\.([0-9])', '\\1' || chr(57344) || '\\2', 'g'), '([0-9])\\.([0-9])', '\\1' || chr(57344) || '\\2', 'g'), '[.:]') IF regexp_matches(c, '[^ \\t\\r\\n]')] AS parts FROM nv))
    WINDOW w AS (PARTITION BY narrative_id ORDER BY clause_no))""",
    "tx": """tx AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS transaction_key,
    CASE WHEN l_linestatus = 'O' THEN 'contract' ELSE 'assistance' END AS award_type,
    CAST(l_shipdate AS DATE) AS action_date,
    CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS DECIMAL(24,4)) AS obligation,
    l_orderkey AS award_id, l_suppkey AS recipient_id, l_partkey AS part_id, o_custkey AS customer_id,
    o_orderpriority AS sub_agency, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "xw": """xw AS (
  SELECT s_suppkey AS recipient_id, s_name AS recipient_name, n_name AS family_key, r_name AS parent_name, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "pl": """pl AS (
  SELECT c_custkey AS customer_id, r_name AS pop_state, n_name AS pop_district
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "ln": """ln AS (
  SELECT p_partkey AS line_id, p_brand AS pe_bli, p_type AS account, left(p_name, 1) AS organization,
    CAST(p_size % 10 + 2017 AS INTEGER) AS edition_year,
    CASE p_partkey % 3 WHEN 0 THEN concat('fy_', p_size % 10 + 2015, '_actuals') WHEN 1 THEN concat('fy_', p_size % 10 + 2016, '_total')
      ELSE concat('fy_', p_size % 10 + 2017, '_request') END AS amount_type,
    p_name AS title, CASE (p_partkey // 3) % 3 WHEN 0 THEN 'R-1' WHEN 1 THEN 'P-1' ELSE 'P-1R' END AS exhibit,
    CAST(p_retailprice AS DECIMAL(18,2)) AS amount_thousands
  FROM part)""",
    "lk": """lk AS (
  SELECT p_brand AS pe_bli, l_orderkey AS award_id,
    CASE max(CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "fl": """fl AS (
  SELECT o_orderkey AS filing_id, o_custkey AS registrant, CAST(year(o_orderdate) AS INTEGER) AS filing_year, CAST(quarter(o_orderdate) AS INTEGER) AS filing_period,
    CASE o_orderstatus WHEN 'F' THEN 'RR' WHEN 'P' THEN '1A' ELSE 'Q1' END AS filing_type,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS income_usd
  FROM orders)""",
}


def with_sql(names: str, body: str) -> str:
    """``body`` after the common table expressions ``names``; ``body`` may start with
    further ones (a leading comma)."""
    head = "WITH " + ",\n".join(SQL[n] for n in names.split())
    return head + ("" if body.lstrip().startswith(",") else "\n") + body
