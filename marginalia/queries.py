"""Registered queries over the driver's tables, each with the same question in DuckDB SQL.

The tables hold no source files, so comments, code, subjects and directives are derived from ``lineitem`` and
``orders`` by one projection that both engines run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import blocks as B
from .operators import dispatch as D
from .operators import report as R
from .operators import rules, spread
from .plans import registry as P
from .plans import vocabulary as V
from .sources import files as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LANGS = list(V.LANGUAGES)
#: Bodies of the derived comments; ``|`` stands for a line break.
BODIES = [
    "plain words about the order", "this was Previously elsewhere", "-----", "Step 3: ship it", "-- HELPERS --", "=== Setup ===", "adapted from the manual", "it should work for now",
    "handles the logic, etc.", "and so on, etc.)", "TODO fix this", "TODO(#12) later XXX now", "TODOs remain", "HACK( ) here", "see (parser.go). and https://x.y/a.rs", "use `now we` as a word",
    "odd ` tick now we go", "Copyright someone|all of it", "marginalia:ignore narration — history", "marginalia:ignore task", "marginalia:ignore hedging - because", "go:generate stringer", "customer name | TODO: soon", "pending deposits | furiously",
]


def _literal(x: str) -> str:
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in x.split("|"))


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {_literal(v)}" for i, v in enumerate(values)) + " END"


_BODY = _case(f"(l_partkey + 3 * l_suppkey) % {len(BODIES)}", BODIES)
_LANG = _case(f"l_orderkey % {len(LANGS)}", LANGS)
_ORDER = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"
_COMMENTS = [
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, {_BODY} AS body, {_LANG} AS lang FROM lineitem",
    "SELECT *, CAST(length(body) - length(replace(body, chr(10), '')) AS BIGINT) AS breaks FROM raw",
    f"SELECT 'src/' || CAST(l_orderkey AS VARCHAR(20)) AS path, lang, body, breaks, l_partkey, l_suppkey, CAST(sum(breaks + 1 + l_partkey % 2) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_row FROM counted",
    "SELECT path, lang, body, 100 * (end_row - breaks) AS start, 100 * end_row + 50 AS \"end\", end_row - breaks AS start_row, end_row, l_suppkey % 5 = 0 AS is_trailing, l_partkey % 7 = 0 AS is_doc, CASE WHEN l_suppkey % 3 = 0 THEN 'block' ELSE 'line' END AS kind, l_partkey, l_suppkey FROM placed",
]
D_COMMENTS = "WITH raw AS ({}), counted AS ({}), placed AS ({}), d_comments AS ({})".format(*_COMMENTS)
D_RUNS = (
    D_COMMENTS
    + """, lagged AS (SELECT *, lag(end_row) OVER w AS pe, lag(is_trailing) OVER w AS pt FROM d_comments WINDOW w AS (PARTITION BY path ORDER BY start)),
runs AS (SELECT * EXCLUDE (pe, pt), CAST(sum(CASE WHEN pe + 1 = start_row AND NOT pt AND NOT is_trailing THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY start ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM lagged)"""
)
_STRIPPED = "regexp_replace(body, '^\\s+|\\s+$', '', 'g')"
_DIRECTIVE = "(" + " OR ".join("(lang = '{}' AND ({}))".format(k, " OR ".join(f"starts_with({_STRIPPED}, '{p}')" for p in v["directives"])) for k, v in V.LANGUAGES.items()) + ")"
_RULE = f"CASE WHEN starts_with({_STRIPPED}, '{V.IGNORE_MARKER}') THEN trim(regexp_extract({_STRIPPED}, '(?s)^{V.IGNORE_MARKER}([^—\\-]*)', 1)) END"
_REASON = f"CASE WHEN starts_with({_STRIPPED}, '{V.IGNORE_MARKER}') THEN nullif(trim(regexp_extract({_STRIPPED}, '(?s)^{V.IGNORE_MARKER}[^—\\-]*[—\\-](.*)$', 1)), '') END"
D_BLOCKS = (
    D_RUNS
    + f""", told AS (SELECT *, {_DIRECTIVE} AS is_directive, {_RULE} AS rule, {_REASON} AS reason, bool_or(is_doc) OVER r AS run_doc, max("end") OVER r AS run_end, max(end_row) OVER r AS run_end_row FROM runs WINDOW r AS (PARTITION BY path, run)),
grouped AS (SELECT path, run, first(lang) AS lang, CASE WHEN bool_or(run_doc) THEN 'doc' ELSE arg_min(kind, start) END AS kind, max(run_end) AS run_end, max(run_end_row) AS run_end_row, min(start) AS start, max("end") AS "end", min(start_row) AS start_row, max(end_row) AS end_row, bool_or(is_trailing) AS is_trailing,
 CAST(sum(end_row - start_row + 1) AS BIGINT) AS line_count, string_agg(body, chr(10) ORDER BY start) AS body FROM told WHERE NOT is_directive AND rule IS NULL GROUP BY path, run),
blocks AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY start) AS INTEGER) AS block FROM grouped),
directives AS (SELECT path, start, start_row, "end", rule, reason FROM told WHERE rule IS NOT NULL AND NOT is_directive),
met AS (SELECT d.path, d.start, d.rule, d.reason, min(b.block) AS block FROM directives d JOIN blocks b ON b.path = d.path AND b.start_row IN (d.start_row, d.start_row + 1) GROUP BY ALL),
held AS (SELECT path, block, arg_max(rule, start) AS rule, arg_max(coalesce(reason, ''), start) AS reason0 FROM met GROUP BY path, block),
nodes AS (SELECT path, "end" + 50 + 100 * (l_suppkey % 2) AS start, "end" + 90 + 100 * (l_suppkey % 2) AS "end", end_row + 1 + l_suppkey % 2 AS start_row, end_row + 1 + l_suppkey % 2 AS end_row, ("end" + 50 + 100 * (l_suppkey % 2)) % 7 AS subject FROM d_comments WHERE l_partkey % 3 = 0),
attached AS (SELECT b.*, n.subject AS n_subject, CASE WHEN b.is_trailing THEN 'trailing' WHEN n.start_row = b.run_end_row + 1 THEN 'below' ELSE 'detached' END AS attachment FROM blocks b ASOF LEFT JOIN nodes n ON b.path = n.path AND n.start >= b.run_end)"""
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """The derived comments, by the same projection as in SQL.

    The rows are dealt out by path before anything is derived from them: all that follows is by path, and the branches of a
    query that read comments, nodes or directives share that one exchange.  Its partitions follow the size of the table.
    """
    table = _table(spark, sf, "lineitem")
    path = F.concat(F.lit("src/"), F.col("l_orderkey").cast("string")).alias("path")
    dealt = table.select(path, "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").repartition(spread.parts(table, 2 << 20), "path")
    sql = D_COMMENTS.replace("SELECT l_orderkey,", "SELECT path, l_orderkey,").replace("'src/' || CAST(l_orderkey AS VARCHAR(20)) AS path", "path").replace("PARTITION BY l_orderkey", "PARTITION BY path")
    sql = sql.replace('"end"', "`end`").replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM d_comments"
    out = spark.sql(sql, lineitem=dealt.withColumn("l_orderkey", F.substring("path", 5, 20).cast("long")))
    out = out.select(*(F.col(c).alias(c) for c in out.columns))  # a union knows its parts as dealt alike only if no name keeps the table's
    return out.withColumn("is_shebang", F.lit(False)).withColumn("doc_subject", F.lit(None).cast("long"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    c = comments(spark, sf).where("l_partkey % 3 = 0")
    gap = F.col("l_suppkey") % 2
    row = F.col("end_row") + 1 + gap
    return c.select("path", (F.col("end") + 50 + 100 * gap).alias("start"), (F.col("end") + 90 + 100 * gap).alias("end"), row.alias("start_row"), row.alias("end_row"), ((F.col("end") + 50 + 100 * gap) % 7).alias("subject"), F.array(F.lit("customer"), F.lit("name")).alias("identifiers"), F.lit(False).alias("in_error"))


def marked(spark: SparkSession, sf: str) -> DataFrame:
    return B.marked(B.with_runs(comments(spark, sf)))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return B.blocks_of(marked(spark, sf))


def directives(spark: SparkSession, sf: str) -> DataFrame:
    return marked(spark, sf).where("rule is not null and not is_directive").select("path", "start", "end", "start_row", "rule", "reason")


def attached(spark: SparkSession, sf: str) -> DataFrame:
    return B.attach(blocks(spark, sf), nodes(spark, sf))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Text rules.

_TICKS = "(length(body) - length(replace(body, '`', '')))"
_NORM = f"trim(regexp_replace(CASE WHEN {_TICKS} % 2 = 0 THEN regexp_replace(body, '`[^`]*`', ' ', 'g') ELSE body END, '\\s+', ' ', 'g'))"
_EDGE = "[^\\p{L}\\p{N}_]"


def _first(terms) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower({_NORM}), '(^|{_EDGE}){t}($|{_EDGE})') THEN '{t}' END" for t in terms) + ")"


def _term_query(name: str, terms) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return comments(spark, sf).withColumn("term", T.first_match(F.col("body"), terms)).where("term is not null").select("path", "start", "term")

    run.__name__ = name
    query(f"{D_COMMENTS} SELECT path, start, term FROM (SELECT *, {_first(terms)} AS term FROM d_comments) WHERE term IS NOT NULL")(run)


for _name, _terms in (("narration_blocks", V.NARRATION), ("attribution_blocks", V.ATTRIBUTION), ("hedging_blocks", V.HEDGING)):
    _term_query(_name, _terms)


@query(f"""{D_COMMENTS} SELECT path, start, coalesce({_first(V.VAGUE)}, CASE WHEN regexp_matches(regexp_replace(lower(trim(regexp_replace(body, '\\s+', ' ', 'g'))), '[. )\\]"'']+$', ''), '(^|[ ,])etc$') THEN 'etc' END) AS term
FROM d_comments WHERE term IS NOT NULL""")
def vague_blocks(spark: SparkSession, sf: str) -> DataFrame:
    term = F.coalesce(T.first_match(F.col("body"), V.VAGUE), F.when(T.ends_with_etc(F.col("body")), "etc"))
    return comments(spark, sf).withColumn("term", term).where("term is not null").select("path", "start", "term")


_BARE = "regexp_matches(regexp_replace({0}, '(^|[^\\p{{L}}\\p{{N}}_]){1}\\([^)]*[^)\\s][^)]*\\)', ' ', 'g'), '(^|[^\\p{{L}}\\p{{N}}_]){1}')"


@query(f"{D_COMMENTS} SELECT path, start, coalesce({', '.join('CASE WHEN ' + _BARE.format(_NORM, m) + f' THEN {chr(39)}{m}{chr(39)} END' for m in V.TASK_MARKERS)}) AS marker FROM d_comments WHERE marker IS NOT NULL")
def task_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return comments(spark, sf).withColumn("marker", T.task_without_reference(F.col("body"))).where("marker is not null").select("path", "start", "marker")


_LINES = "list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""{D_COMMENTS}, cut AS (SELECT *, {_LINES} AS lines FROM d_comments),
judged AS (SELECT path, start, CASE WHEN len(lines) = 0 THEN NULL WHEN len(list_filter(lines, lambda x: NOT regexp_full_match(x, '[-=*_#~+]{{3,}}'))) = 0 THEN 'a rule of repeated punctuation'
 WHEN len(list_filter(lines, lambda x: NOT regexp_matches(lower(x), '^step\\s*[0-9]+\\s*($|[:.)-])'))) = 0 THEN 'a step number'
 WHEN NOT is_trailing AND len(lines) = 1 AND NOT regexp_matches(lines[1], '(^|{_EDGE})(TODO|FIXME|XXX|HACK)($|{_EDGE})') AND ((length(regexp_replace(lines[1], '[^\\p{{L}}]', '', 'g')) >= 2 AND NOT regexp_matches(lines[1], '\\p{{Ll}}'))
  OR regexp_matches(lines[1], '^[-=*_#~+]{{3}}.*\\p{{L}}.*[-=*_#~+]{{3}}$')) THEN 'a section label' END AS reason FROM cut) SELECT * FROM judged WHERE reason IS NOT NULL""")
def banner_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return comments(spark, sf).withColumn("why", T.banner_reason(F.col("body"), F.col("is_trailing"))).where("why is not null").select("path", "start", F.col("why").alias("reason"))


_TRIM = "regexp_replace({}, '^[()\\[\\]:,;\"''`]+|[()\\[\\]:,;\"''`]+$', '', 'g')"
_PATH = _TRIM.format("regexp_replace(" + _TRIM.format("w") + ", '\\.+$', '')")
_REFS = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v['references'] or '[]::VARCHAR[]'}" for k, v in V.LANGUAGES.items()) + " END"


@query(f"""{D_COMMENTS}, split AS (SELECT path, start, lang, unnest(string_split(regexp_replace(body, '\\s+', ' ', 'g'), ' ')) AS w, generate_subscripts(string_split(regexp_replace(body, '\\s+', ' ', 'g'), ' '), 1) AS i FROM d_comments),
clean AS (SELECT path, start, lang, i, {_PATH} AS p FROM split)
SELECT path, start, arg_min(p, i) AS found FROM clean WHERE NOT contains(p, '://') AND regexp_matches(p, '.\\.[^.]+$') AND list_contains({_REFS}, regexp_extract(p, '\\.([^.]+)$', 1)) GROUP BY path, start""")
def fileref_blocks(spark: SparkSession, sf: str) -> DataFrame:
    found = T.source_path(F.col("body"), rules.references(F.col("lang")))
    return comments(spark, sf).withColumn("found", found).where("found is not null").select("path", "start", "found")


# Functions on their own.


@query(
    "SELECT c_custkey, list_filter(string_split(lower(regexp_replace(regexp_replace(replace(c_name || '-' || replace(c_mktsegment, 'BUILD', 'buildHTTP') || 'parseHTTPResponse', '#', '_'), '([^A-Z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][^A-Z])', '\\1_\\2', 'g')).replace('-', '_'), '_'), lambda x: x <> '') AS parts FROM customer"
)
def split_identifier(spark: SparkSession, sf: str) -> DataFrame:
    name = F.replace(F.concat("c_name", F.lit("-"), F.replace(F.col("c_mktsegment"), F.lit("BUILD"), F.lit("buildHTTP")), F.lit("parseHTTPResponse")), F.lit("#"), F.lit("_"))
    return _table(spark, sf, "customer").select("c_custkey", T.split_identifier(name).alias("parts"))


@query(f"{D_COMMENTS} SELECT path, start, {_NORM} AS plain FROM d_comments")
def code_span_strip(spark: SparkSession, sf: str) -> DataFrame:
    return comments(spark, sf).select("path", "start", T.normalise(T.strip_code_spans(F.col("body"))).alias("plain"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS body FROM pages")
def page_html_comments(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<!--(.*?)-->"), 1)).alias("body"))


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)^\\s*(copyright|licence|license|spdx-license-identifier|all rights reserved)'))) > 0")
def licence_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").where(T.is_licence_text(F.col("text"))).select("doc_id")


# Blocks.


@query(f"{D_RUNS} SELECT path, run, count(*) AS n, min(start_row) AS start_row, max(end_row) AS end_row FROM runs GROUP BY path, run")
def comment_runs(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_runs(comments(spark, sf)).groupBy("path", "run").agg(F.count("*").alias("n"), F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row"))


@query(f"{D_RUNS} SELECT path, start, run FROM runs WHERE NOT {_DIRECTIVE}")
def directive_drop(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_runs(comments(spark, sf)).where(~B.is_machine_directive(F.col("body"), F.col("lang"))).select("path", "start", "run")


@query(f"{D_BLOCKS} SELECT path, start, rule, reason FROM directives")
def ignore_parse(spark: SparkSession, sf: str) -> DataFrame:
    return directives(spark, sf).select("path", "start", "rule", "reason")


@query(f"{D_BLOCKS} SELECT path, block, rule, nullif(reason0, '') AS reason FROM held")
def ignore_binding(spark: SparkSession, sf: str) -> DataFrame:
    return B.bind(blocks(spark, sf), directives(spark, sf))[0].select("path", "block", "rule", "reason")


@query(f"{D_BLOCKS} SELECT path, start FROM directives ANTI JOIN met USING (path, start)")
def loose_directives(spark: SparkSession, sf: str) -> DataFrame:
    return B.bind(blocks(spark, sf), directives(spark, sf))[1].select("path", "start")


@query(f"{D_BLOCKS} SELECT path, block, kind, start, \"end\", line_count, body FROM blocks")
def block_text(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).select("path", "block", "kind", "start", "end", "line_count", "body")


@query(f"""{D_BLOCKS}, placed_blocks AS (SELECT path, block, attachment, n_subject FROM attached), beside AS (SELECT b.path, b.block, CASE WHEN n.end_row = b.start_row THEN n.subject END AS subject FROM blocks b ASOF LEFT JOIN nodes n ON b.path = n.path AND b.start >= n."end")
SELECT path, block, attachment, CASE attachment WHEN 'trailing' THEN beside.subject WHEN 'below' THEN n_subject END AS subject, CASE WHEN attachment = 'below' OR (attachment = 'trailing' AND beside.subject IS NOT NULL) THEN ['customer', 'name'] ELSE [] END AS attached FROM placed_blocks JOIN beside USING (path, block)""")
def attachment(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects here are those of the node, for doc comments too."""
    b = blocks(spark, sf).withColumn("kind", F.lit("line"))
    return B.attach(b, nodes(spark, sf)).select("path", "block", "attachment", "subject", "attached")


@query(f"{D_BLOCKS} SELECT path, block FROM attached WHERE attachment = 'detached'")
def detached_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return attached(spark, sf).where("attachment = 'detached'").select("path", "block")


@query(f"""{D_BLOCKS} SELECT path, block FROM blocks WHERE NOT (block = 1 AND kind <> 'doc' AND start_row < 10
 AND len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '(?i)^\\s*(copyright|licence|license|spdx-license-identifier|all rights reserved)'))) > 0)""")
def licence_header(spark: SparkSession, sf: str) -> DataFrame:
    return B.without_licence(blocks(spark, sf)).select("path", "block")


_TOKENS = "list_filter(string_split(regexp_replace(lower(body), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '' AND NOT list_contains(" + str(list(V.STOPWORDS)) + ", x))"


@query(f"{D_BLOCKS}, t AS (SELECT *, {_TOKENS} AS tokens FROM attached) SELECT path, block FROM t WHERE attachment <> 'detached' AND len(tokens) > 0 AND len(list_filter(tokens, lambda x: NOT list_contains(['customer', 'name', 'todo', 'soon'], x))) = 0")
def restate_subset(spark: SparkSession, sf: str) -> DataFrame:
    names = F.lit(["customer", "name", "todo", "soon"])
    return attached(spark, sf).where((F.col("attachment") != "detached") & rules.restates(F.col("body"), names)).select("path", "block")


# Subjects.

_SUBJECTS = "SELECT 'src/' || CAST(o_orderkey AS VARCHAR(20)) AS path, k AS subject, 100 * 3 * k AS start, 100 * (3 * k + 4 + o_custkey % 9) AS \"end\", 1 + (o_custkey + k) % 6 AS code_lines, o_custkey % 4 AS member_count, (o_custkey + k) % 11 = 0 AS file_scope FROM orders, ks"


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    sql = "WITH ks AS (SELECT explode(sequence(0, 2)) AS k) " + _SUBJECTS.replace("VARCHAR(20)", "STRING").replace('"end"', "`end`").replace("FROM orders, ks", "FROM {orders} CROSS JOIN ks")
    return spark.sql(sql, orders=_table(spark, sf, "orders")).withColumn("code_lines", F.col("code_lines").cast("long"))


_SUBS = f", ks AS (SELECT unnest([0, 1, 2]) AS k), subjects AS ({_SUBJECTS})"


@query(f"""{D_BLOCKS}{_SUBS}, inside AS (SELECT s.path, s.subject, any_value(s.code_lines) AS code_lines, CAST(sum(b.line_count) AS BIGINT) AS comment_lines, bool_or(b.kind <> 'doc') AS known FROM subjects s JOIN blocks b ON b.path = s.path AND b.start >= s.start AND b."end" <= s."end"
 WHERE NOT s.file_scope AND s.code_lines > 0 GROUP BY s.path, s.subject) SELECT path, subject, comment_lines, comment_lines > 2 * sqrt(code_lines) AS noted FROM inside WHERE known AND comment_lines > sqrt(code_lines)""")
def density(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks(spark, sf).withColumn("subject", F.lit(None).cast("long")).withColumn("in_error", F.lit(False))
    return D.density(b, subjects(spark, sf), P.thresholds(spark)).select("path", "subject", "comment_lines", F.col("note").isNotNull().alias("noted"))


@query(f"""{D_BLOCKS}{_SUBS} SELECT b.path, b.block, line_count, member_count, CASE WHEN member_count > 0 AND line_count > member_count * 1 THEN 'relative' ELSE 'absolute' END AS arm FROM blocks b JOIN subjects s ON b.path = s.path AND s.subject = 0
 WHERE kind = 'doc' AND (line_count > 2 OR (member_count > 0 AND line_count > member_count * 1))""")
def docbloat(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks(spark, sf).where("kind = 'doc'").join(subjects(spark, sf).where("subject = 0").select("path", "member_count"), "path")
    text, _ = rules.docbloat(F.col("line_count"), F.col("member_count"), F.lit(2), F.lit(1))
    arm = F.when(F.col("text").contains("documenting"), "relative").otherwise("absolute")
    return b.withColumn("text", text).where("text is not null").select("path", "block", "line_count", "member_count", arm.alias("arm"))


@query(f"""{D_BLOCKS}, names AS (SELECT * FROM (VALUES (0, 'parser', 'private'), (1, 'customer', 'restricted'), (2, 'order', 'exported'), (3, 'furiously', 'private')) t(ord, name, vis))
SELECT path, block, arg_min(name, ord) AS leaked FROM blocks, names WHERE kind = 'doc' AND vis <> 'exported' AND length(name) >= 3 AND regexp_matches(body, '(^|{_EDGE})' || name || '($|{_EDGE})') AND (name <> 'customer') GROUP BY path, block""")
def impl_leak(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks(spark, sf).where("kind = 'doc'")
    names = spark.createDataFrame([(0, "parser", "private"), (1, "customer", "restricted"), (2, "order", "exported"), (3, "furiously", "private")], "ord int, name string, vis string")
    return rules.leaked_names(b, b.select("path").distinct().crossJoin(F.broadcast(names)), ("customer",))


# Dispatch and report.

_HITS = f"hits AS MATERIALIZED (SELECT path, block, 'narration' AS rule FROM attached WHERE {_first(V.NARRATION)} IS NOT NULL UNION ALL SELECT path, block, 'hedging' FROM attached WHERE {_first(V.HEDGING)} IS NOT NULL UNION ALL SELECT path, block, 'detached' FROM attached WHERE attachment = 'detached' UNION ALL SELECT path, block, 'banner' FROM attached WHERE regexp_full_match(body, '[-=*_#~+]{{3,}}'))"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("body")
    fired = {"narration": T.first_match(body, V.NARRATION).isNotNull(), "hedging": T.first_match(body, V.HEDGING).isNotNull(), "detached": F.col("attachment") == "detached", "banner": body.rlike(f"^{T.RULE}{{3,}}$")}
    return attached(spark, sf).select("path", "block", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in fired.items())))).alias("rule"))


@query(f"""{D_BLOCKS}, {_HITS}, won AS MATERIALIZED (SELECT DISTINCT path, block FROM hits WHERE rule IN ('banner', 'commentedOutCode'))
SELECT path, block, rule FROM hits WHERE rule <> 'detached' UNION ALL SELECT h.path, h.block, h.rule FROM hits h ANTI JOIN won USING (path, block) WHERE h.rule = 'detached'""")
def precedence(spark: SparkSession, sf: str) -> DataFrame:
    return D.without_losers(_hits(spark, sf))


@query(f"{D_BLOCKS}, {_HITS} SELECT h.path, h.block, h.rule, d.rule IS NOT NULL AS suppressed FROM hits h LEFT JOIN held d ON d.path = h.path AND d.block = h.block AND d.rule = h.rule")
def suppression(spark: SparkSession, sf: str) -> DataFrame:
    return D.suppressed(_hits(spark, sf), B.bind(blocks(spark, sf), directives(spark, sf))[0])


@query(f"{D_BLOCKS}, {_HITS} SELECT path, block, rule FROM held d WHERE rule IN ('narration', 'hedging') AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.path = d.path AND h.block = d.block AND h.rule = d.rule)")
def dead_ignore(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks(spark, sf)
    told = [F.struct(F.lit(r).alias("rule"), T.first_match(F.col("body"), terms).isNotNull().alias("fired")) for r, terms in (("narration", V.NARRATION), ("hedging", V.HEDGING))]
    tried = b.select("path", "block", F.inline(F.array(*told)))  # both rules read the text alone, so no block is attached
    return D.dead_ignores(B.bind(b, directives(spark, sf))[0], tried).select("path", "block", "rule")


@query(f"{D_BLOCKS} SELECT path, block, rule FROM held WHERE reason0 = '' UNION ALL SELECT path, CAST(NULL AS INTEGER), rule FROM directives ANTI JOIN met USING (path, start) WHERE reason IS NULL")
def ignore_reason(spark: SparkSession, sf: str) -> DataFrame:
    held, loose = B.bind(blocks(spark, sf), directives(spark, sf))
    found = D.missing_reasons(held, loose)
    return found.select("path", "block", F.regexp_extract("instruction", f"`{V.IGNORE_MARKER} (\\S*) —", 1).alias("rule"))


_ALLOWED = ["restate", "detached", "narration", "banner", "commentedOutCode", "attribution", "fileref", "hedging", "vague", "task", "docbloat", "implInInterface"]


@query(f"""{D_BLOCKS}, bad AS (SELECT *, block % 3 = 0 AS e, length(path) % 2 = 0 AS f FROM blocks)
SELECT path, list_sort(list_distinct(flatten(list(CASE WHEN kind = 'doc' THEN (CASE WHEN e THEN ['docbloat'] ELSE [] END) || (CASE WHEN f THEN ['implInInterface'] ELSE [] END) WHEN e THEN ['restate', 'detached'] ELSE [] END)))) AS rules
FROM bad WHERE e OR (f AND kind = 'doc') GROUP BY path""")
def withheld(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks(spark, sf).withColumn("in_error", F.col("block") % 3 == 0).withColumn("file_error", F.length("path") % 2 == 0)
    return D.withheld_rules(D.allowed(b, P.registry(spark)))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with repeats, one per block and pass."""
    b = attached(spark, sf).withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1))))
    return b.select("path", "start", "end", F.when(F.col("ord") == 1, "task").otherwise(F.element_at(F.array(F.lit("task"), F.lit("vague")), (F.col("block") % 2 + 1).cast("int"))).alias("rule"), (F.col("start_row") + 1).alias("line"), F.lit(1).alias("col"), F.when(F.col("kind") == "doc", "gate").otherwise("warn").alias("tier"), F.lit("none").alias("fix"), F.concat(F.lit("look at "), F.col("kind")).alias("instruction"), F.when(F.col("line_count") > 2, "long").alias("note"), (F.col("block") % 5 == 0).alias("suppressed"), "ord")


_FOUND = "found AS (SELECT path, start, \"end\", CASE WHEN ord = 1 OR block % 2 = 0 THEN 'task' ELSE 'vague' END AS rule, start_row + 1 AS line, 1 AS col, CASE WHEN kind = 'doc' THEN 'gate' ELSE 'warn' END AS tier, 'none' AS fix, 'look at ' || kind AS instruction, CASE WHEN line_count > 2 THEN 'long' END AS note, block % 5 = 0 AS suppressed, ord FROM attached, (VALUES (0), (1)) o(ord))"


@query(f"{D_BLOCKS}, {_FOUND} SELECT path, start, rule, line, min(ord) AS ord FROM found GROUP BY path, start, rule, line")
def report_order_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return R.ordered(R.without_repeats(_findings(spark, sf))).select("path", "start", "rule", "line", "ord")


@query(f"{D_BLOCKS}, {_FOUND} SELECT path || ':' || line || ':' || col || ': ' || tier || ' [' || rule || '] ' || instruction || coalesce(chr(10) || '  note: ' || note, '') AS text FROM found WHERE NOT suppressed")
def human_lines(spark: SparkSession, sf: str) -> DataFrame:
    return R.human_line(R.active(_findings(spark, sf))).select("text")


@query(f"{D_BLOCKS}, {_FOUND} SELECT concat_ws(chr(9), 'finding', rule, path, start, \"end\", line, col, tier, fix) || chr(10) || chr(9) || 'instruction' || chr(9) || instruction || coalesce(chr(10) || chr(9) || 'note' || chr(9) || note, '') AS text FROM found WHERE NOT suppressed")
def machine_lines(spark: SparkSession, sf: str) -> DataFrame:
    return R.machine_line(R.active(_findings(spark, sf))).select("text")


@query(f"{D_BLOCKS}, {_FOUND} SELECT CAST(coalesce(bool_or(tier = 'gate' AND NOT suppressed), false) AS INTEGER) AS exit_code FROM found")
def exit_code(spark: SparkSession, sf: str) -> DataFrame:
    return R.exit_code(_findings(spark, sf))


@query(f"""{D_COMMENTS}, spans AS (SELECT path, start, start + 100 + (l_suppkey % 4) * 60 AS "end" FROM d_comments), cut AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY path ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM spans),
isles AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS isle FROM cut) SELECT path, min(start) AS start, max("end") AS "end" FROM isles GROUP BY path, isle""")
def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    return R.merged(comments(spark, sf).select("path", "start", (F.col("start") + 100 + (F.col("l_suppkey") % 4) * 60).alias("end")))


_FILES = "files AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'a/vendor/' WHEN o_orderkey % 5 = 1 THEN 'a/.x/' ELSE 'src/' END || CASE o_orderkey % 8 WHEN 0 THEN 'm.go' WHEN 1 THEN 'm.test.ts' WHEN 2 THEN '.bashrc' WHEN 3 THEN 'script' WHEN 4 THEN 'a.PY' WHEN 5 THEN 'b.py' WHEN 6 THEN 'c.java' ELSE 'd.' END AS path, CASE WHEN o_orderkey % 11 = 0 THEN '// Code generated by x' ELSE '// ' || o_orderpriority END AS content FROM orders)"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("WITH " + _FILES.replace("FROM orders", "FROM {orders}") + " SELECT * FROM files", orders=_table(spark, sf, "orders"))


@query(f"WITH {_FILES} SELECT o_orderkey, path FROM files WHERE NOT list_has_any(string_split(path, '/'), ['testdata', 'fixtures', 'vendor', 'node_modules'])")
def excluded_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).where(S.not_excluded(F.col("path"))).select("o_orderkey", "path")


@query(f"WITH {_FILES}, named AS (SELECT *, string_split(path, '/')[-1] AS name FROM files), known AS (SELECT * FROM (VALUES {', '.join(f'({e!r}, {k!r})' for k, v in V.LANGUAGES.items() for e in v['extensions'])}) t(ext, lang)) SELECT o_orderkey, lang FROM named JOIN known ON regexp_extract(name, '^.+\\.([^.]*)$', 1) = ext")
def pack_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return _files(spark, sf).withColumn("lang", S.language_of(name)).where("lang is not null").select("o_orderkey", "lang")


@query(f"WITH {_FILES} SELECT o_orderkey FROM files WHERE contains(content, 'Code generated by ')")
def generated_files(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).where(S.is_generated(F.lit("go"), F.col("content"))).select("o_orderkey")


@query("""WITH n AS (SELECT n_name AS lang, n_nationkey AS k FROM nation), d AS (SELECT lang, name, v FROM n, (VALUES ('a', 1), ('b', 2), ('c', 3)) t(name, v))
SELECT d.lang, d.name, CAST(coalesce(CASE WHEN d.name = 'b' AND k % 2 = 0 THEN k END, CASE WHEN d.name = 'a' THEN 9 END, v) AS INTEGER) AS value FROM d JOIN n USING (lang)""")
def config_layering(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "nation").select(F.col("n_name").alias("lang"), F.col("n_nationkey").alias("k"))
    base = n.select("lang", F.explode(F.lit([1, 2, 3])).alias("value")).withColumn("name", F.element_at(F.lit(["a", "b", "c"]), F.col("value")))
    general = spark.createDataFrame([("a", 9)], "name string, value int")
    return D.layered(spark, base, general, n.where("k % 2 = 0").select("lang", F.lit("b").alias("name"), F.col("k").cast("int").alias("value")))


# These need a parser; the files follow a rule, so SQL can state what is in them.

_SOURCES = {"go": "package p\n\n// Previously f{k} was here\nfunc F{k}(a int) int {{\n\treturn a // TODO\n}}\n\n// x := f(1)\n\nvar y = 1\n", "python": '"""M."""\n\n\ndef f{k}(x):\n    """F."""\n    y = x\n    # now we return\n    return y\n'}


def _made_files(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "customer")
    c = c.select("c_custkey").repartition(spread.parts(c, 256 << 10), "c_custkey")  # a row makes a whole file to parse
    o = c.select(F.concat(F.lit("src/"), F.col("c_custkey").cast("string")).alias("path"), (F.col("c_custkey") % 2).alias("k"), F.col("c_custkey").cast("string").alias("id"))
    text = F.when(F.col("k") == 0, F.replace(F.lit(_SOURCES["go"].format(k="NN")), F.lit("NN"), F.col("id"))).otherwise(F.replace(F.lit(_SOURCES["python"].format(k="NN")), F.lit("NN"), F.col("id")))
    return o.select("path", F.when(F.col("k") == 0, "go").otherwise("python").alias("lang"), text.alias("content"))


_NAMED = "made AS (SELECT 'src/' || CAST(c_custkey AS VARCHAR) AS path, CAST(c_custkey AS VARCHAR) AS id, length(CAST(c_custkey AS VARCHAR)) AS n, c_custkey % 2 = 0 AS go FROM customer)"
#: What is to be found in the files: for Go or not, start and end less the digits of the name (once or twice), rule, line, column, tier, fix.
_EXPECTED = [
    (True, 11, 0, 35, 1, "narration", 3, 1, "warn", "rewrite", 'remove this comment: it narrates the edit ("previously") rather than describing the code'),
    (True, 66, 2, 73, 2, "task", 5, 11, "warn", "rewrite", "add an issue reference to this TODO, as TODO(#123) or TODO(KAT-45), or delete it"),
    (True, 77, 2, 89, 2, "commentedOutCode", 8, 1, "gate", "delete", "delete this commented-out code: version control already has it"),
    (False, 48, 1, 63, 1, "narration", 7, 5, "gate", "delete", 'remove this comment: it narrates the edit ("now we") rather than describing the code'),
]
_VALUES = ", ".join("({}, {}, {}, {}, {}, '{}', {}, {}, '{}', '{}', '{}')".format(*x) for x in _EXPECTED)


@query(f"""WITH {_NAMED}, told(go, a, an, z, zn, rule, line, col, tier, fix, instruction) AS (VALUES {_VALUES})
SELECT path, CAST(a + an * n AS BIGINT) AS start, CAST(z + zn * n AS BIGINT) AS "end", rule, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, tier, fix, instruction, false AS suppressed FROM made JOIN told USING (go)""")
def check_files(spark: SparkSession, sf: str) -> DataFrame:
    from .check import check

    return check(_made_files(spark, sf)).findings.select("path", "start", "end", "rule", "line", "col", "tier", "fix", "instruction", "suppressed")


@query(f"WITH {_NAMED}" + ''' SELECT path, replace(replace('"""M."""|||def fNN(x):|    """F."""|    y = x|    return y|', '|', chr(10)), 'NN', id) AS content FROM made WHERE NOT go''')
def fix_text(spark: SparkSession, sf: str) -> DataFrame:
    """Files that the deletions switched on by default change."""
    from .check import corrected

    return corrected(_made_files(spark, sf))


@query(f"WITH {_NAMED}, told(go, lang, n_comments, n_nodes, n_subjects, n_symbols) AS (VALUES (true, 'go', 3, 5, 3, 3), (false, 'python', 3, 3, 2, 1)) SELECT path, lang, false AS file_error, n_comments, n_nodes, n_subjects, n_symbols FROM made JOIN told USING (go)")
def parse_facts(spark: SparkSession, sf: str) -> DataFrame:
    from .sources.parse import facts

    return facts(_made_files(spark, sf)).select("path", "lang", "file_error", F.size("comments").alias("n_comments"), F.size("nodes").alias("n_nodes"), F.size("subjects").alias("n_subjects"), F.size("symbols").alias("n_symbols"))
