"""The registered queries over the driver's tables and the SQL they are held against.

The driver's tables stand in for a Markdown corpus: links of pages for image references, documents
and labels for assets and metadata, conversation turns for lines below headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import scalars as S
from .operators import blocks, graph, scans, tables, trees
from .operators import links as linked
from .operators.scan import link_spans, split_spans
from .streaming.arrivals import flag_credentials


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def span_scan(spark, sf_dir):
    return link_spans(_read(spark, sf_dir, "pages"))


def shared_refs(spark, sf_dir):
    links = link_spans(_read(spark, sf_dir, "pages"))
    return links.groupBy("dest").agg(F.count_distinct("page_id").alias("n_docs"), F.count(F.lit(1)).alias("n_refs")).where("n_docs > 1")


def dup_sha(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id")
    return docs.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def secret_lines(spark, sf_dir):
    return flag_credentials(_read(spark, sf_dir, "documents")).withColumn("n_lines", F.col("n_lines").cast("long"))


def category_rollup(spark, sf_dir):
    out = _read(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))
    return out


def unmatched_anti(spark, sf_dir):
    return _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


def unmatched_beside_semi(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), _read(spark, sf_dir, "labels")
    used = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").select("source", "lang").distinct()
    return docs.join(labels, "doc_id", "left_anti").join(used, ["source", "lang"], "left_semi").select("doc_id")


def metadata_left(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


def sequence_numbers(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    n = F.col("seq")
    return scans.segmented(docs, ["source", "lang"], ["doc_id"], seq=scans.row_number()).select("doc_id", "seq", F.concat(F.lit("fig"), S.two_digits(n)).alias("name"))


def evidence_top1(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    tier = F.when(F.col("quality") == 1, 1).when(F.col("toxic") == 1, 2).when(F.col("quality").isNotNull(), 3).otherwise(4)
    rows = docs.join(labels, "doc_id", "left").withColumn("tier", tier)
    w = Window.partitionBy("source").orderBy("tier", F.desc("n_chars"), "doc_id")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "doc_id", F.col("tier").cast("long").alias("tier"))


def cache_keys(spark, sf_dir):
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return _read(spark, sf_dir, "documents").select("doc_id", S.cache_key(sha, F.lit("model"), F.lit("1")).alias("cache_key"), F.left(sha, F.lit(8)).alias("hash8"))


def ascii_slugs(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", S.ascii_slug(F.col("text")).alias("slug"))


def nfkd_slugs(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", S.safe_filename(F.col("text"), F.lit(".PNG"), F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(8)), 80).alias("name"))


def decoded_links(spark, sf_dir):
    links = link_spans(_read(spark, sf_dir, "pages"))
    return links.select("page_id", "i", S.percent_decode(F.col("dest")).alias("decoded"), S.is_remote(F.col("dest")).alias("remote"))


def oversize(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).where("n_bytes > 20000")


def parity_full_outer(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    n = lambda lang: docs.where(F.col("lang") == lang).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    out = graph.parity(n("de"), n("fr"), ["source"], "n")
    return out.select("source", F.coalesce("left_value", F.lit(-1)).alias("left_value"), F.coalesce("right_value", F.lit(-1)).alias("right_value"))


def asof_heading(spark, sf_dir):
    user = F.when(F.col("role") == "user", F.col("turn"))
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return scans.segmented(turns, ["conv_id"], ["turn"], heading=scans.last_before(user)).select("conv_id", "turn", F.coalesce("heading", F.lit(-1)).alias("heading"))


def adjacent_caption(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("n"))
    near = scans.segmented(turns, ["conv_id"], ["turn"], before=scans.lag(F.col("n")), after=scans.lead(F.col("n")))
    return near.select("conv_id", "turn", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("after", F.lit(-1)).alias("after"))


def outside_ranges(spark, sf_dir):
    """Links that stand in no protected range: an interval anti join. The first item of each list is protected."""
    pages = _read(spark, sf_dir, "pages")
    links = link_spans(pages).select("page_id", "i", "start_b")
    parts = split_spans(pages, "<ul>")
    ranges = parts.select("page_id", F.col("start_b").alias("lo"), (F.col("start_b") + F.octet_length(F.substring_index("part", "</li>", 1))).alias("hi"))
    return scans.outside(links, ranges, ["page_id"], "start_b")


def block_lines(spark, sf_dir):
    """Lines of each conversation written as Markdown: which are protected, which are headings, and the
    nearest heading before each. Users' turns are headings (every fourth an underlined one), assistants'
    stand in fences that hold a shorter fence, system turns in comments."""
    turns = _read(spark, sf_dir, "conversations")
    n = F.col("turn").cast("string")
    hidden = F.concat(F.lit("# "), F.translate(F.left(F.coalesce("text", F.lit("")), F.lit(20)), "\r\n", "  "))
    user = F.when(F.col("turn") % 4 == 0, F.array(F.concat(F.lit("Turn "), n), F.lit("---"))).otherwise(F.array(F.concat(F.lit("## Turn "), n)))
    made = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", F.array(F.lit("~~~~"), F.lit("~~~"), hidden, F.lit("~~~~"))).otherwise(F.array(F.lit("<!-- # note"), F.lit("# note -->")))
    lines = turns.select(F.col("conv_id").cast("string").alias("doc_path"), "turn", F.posexplode(made).alias("k", "text"))
    lines = lines.select("doc_path", (4 * F.col("turn") + F.col("k")).alias("line"), "text")
    out = scans.segmented(blocks.structure(lines), ["doc_path"], ["line"], nearest=scans.last_before(F.col("heading")))
    return out.select("doc_path", "line", "protected", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("nearest", F.lit("")).alias("nearest"))


def tree_changes(spark, sf_dir):
    """What changes when only labelled documents stay and their line breaks become spaces."""
    docs = _read(spark, sf_dir, "documents")
    hashed = lambda df, text: df.select(F.col("doc_id").cast("string").alias("path"), F.sha2(text.cast("binary"), 256).alias("sha256"))
    labelled = docs.join(_read(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return graph.tree_difference(hashed(docs, F.col("text")), hashed(labelled, F.translate("text", "\n", " ")))


def _paths(docs: DataFrame, text) -> DataFrame:
    """Documents as files: path (language, source, tens of the id, id) and sha256 of the text."""
    path = F.concat_ws("/", "lang", "source", F.expr("doc_id div 10").cast("string"), F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), F.sha2(text.cast("binary"), 256).alias("sha256"))


def path_counts(spark, sf_dir):
    """Documents at or below every folder of their paths."""
    return trees.path_counts(_paths(_read(spark, sf_dir, "documents"), F.col("text")))


def folder_changes(spark, sf_dir):
    """Folders that change when toxic documents go and dollar signs become spaces."""
    docs = _read(spark, sf_dir, "documents")
    rest = docs.join(_read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti")
    return trees.folder_changes(_paths(docs, F.col("text")), _paths(rest, F.translate("text", "$", " ")))


def changed_files(spark, sf_dir):
    """The files behind folder_changes."""
    docs = _read(spark, sf_dir, "documents")
    rest = docs.join(_read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti")
    return trees.changed_files(_paths(docs, F.col("text")), _paths(rest, F.translate("text", "$", " ")))


def declared_counts(spark, sf_dir):
    """Lengths that tables of conversations declare: a user's turn begins a table, assistants' turns are
    its rows, a system turn ends it."""
    turns = _read(spark, sf_dir, "conversations")
    row = F.concat(F.lit("| **turn "), F.col("turn").cast("string"), F.lit("** | "), F.format_number(F.char_length("text"), 0), F.lit(" |"))
    made = F.when(F.col("role") == "user", F.array(F.lit(""), F.lit("| Name | Count |"), F.lit("|:---|---:|"))).when(F.col("role") == "assistant", F.array(row)).otherwise(F.array(F.lit("Plain text.")))
    lines = turns.select(F.col("conv_id").cast("string").alias("doc_path"), "turn", F.posexplode(made).alias("k", "text"))
    return tables.declared_counts(lines.select("doc_path", (4 * F.col("turn") + F.col("k")).alias("line"), "text"), "name", "count")


def _linked_lines(turns: DataFrame) -> DataFrame:
    """Each conversation as a document: users' turns are headings that repeat, assistants' link to the second
    heading of a name, to the next conversation, out of the root and, in code, to it again; system turns are comments."""
    n, m = F.col("turn").cast("string"), (F.col("turn") % 3).cast("string")
    after = (F.col("conv_id") + 1).cast("string")
    link = F.concat(F.lit("See [*a* [b]](#turn-"), m, F.lit("-1), [next](../c/"), after, F.lit('.md "Next") and ![no](x.png), [up](../../'), n, F.lit(".md) or `[code]("), after, F.lit(".md)`."))
    text = F.when(F.col("role") == "user", F.concat(F.lit("## Turn "), m, F.lit("!"))).when(F.col("role") == "assistant", link).otherwise(F.lit("<!-- [gone](none.md) -->"))
    return turns.select(F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("doc_path"), "turn", F.posexplode(F.array(text, F.lit(""))).alias("k", "text")).select("doc_path", (2 * F.col("turn") + F.col("k")).alias("line"), "text")


def checked_links(spark, sf_dir):
    """Links of conversations held against their headings and against each other."""
    lines = blocks.structure(_linked_lines(_read(spark, sf_dir, "conversations")))
    out = linked.link_status(linked.ordinary_links(lines), lines.select(F.col("doc_path").alias("path")).distinct(), linked.heading_anchors(lines))
    return out.select("doc_path", "line", F.col("k").cast("long").alias("k"), "raw_destination", "in_code", F.coalesce("target", F.lit("")).alias("target"), "status")


def name_collisions(spark, sf_dir):
    plan = _read(spark, sf_dir, "documents").select(F.concat_ws("-", F.upper("lang"), F.col("n_chars").cast("string")).alias("new_path"))
    return graph.target_collisions(plan)


def summary_counts(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"), F.count_if(F.col("quality").isNull()).alias("missing"), F.count_if(F.col("toxic") == 1).alias("warnings"))


def utf8_count(spark, sf_dir):
    return _read(spark, sf_dir, "documents").agg(F.count_if(S.is_text(F.col("text").cast("binary"))).alias("n_text"))


def rewrite_spans(spark, sf_dir):
    """Each page with its link destinations replaced by numbers: hash and length of the new bytes."""
    pages = _read(spark, sf_dir, "pages")
    links = link_spans(pages).groupBy("page_id").agg(F.collect_list(F.struct(F.col("start_b").alias("start"), (F.col("start_b") + F.octet_length("dest")).alias("end"), F.concat(F.lit("#"), F.col("i").cast("string")).cast("binary").alias("value"))).alias("spans"))
    new = S.rewrite_bytes(F.col("html").cast("binary"), F.col("spans"))
    return pages.join(links, "page_id").select("page_id", F.sha2(new, 256).alias("sha256"), F.octet_length(new).cast("long").alias("n_bytes"))


QUERIES = {f.__name__: f for f in (span_scan, shared_refs, dup_sha, secret_lines, category_rollup, unmatched_anti, unmatched_beside_semi, metadata_left, sequence_numbers, evidence_top1, cache_keys, ascii_slugs, nfkd_slugs, decoded_links, oversize, parity_full_outer, asof_heading, adjacent_caption, outside_ranges, block_lines, tree_changes, path_counts, folder_changes, changed_files, declared_counts, checked_links, name_collisions, summary_counts, utf8_count, rewrite_spans)}

_LINKS = """links AS (
  SELECT page_id, i, split_part(part, '"', 1) AS dest,
         CAST(sum(strlen(part) + 9) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS start_b
  FROM (SELECT page_id, unnest(parts) AS part, CAST(unnest(range(len(parts))) AS BIGINT) AS i
        FROM (SELECT page_id, string_split(html, '<a href="') AS parts FROM pages)))"""

_FILES = """files AS (SELECT *, concat_ws('/', lang, source, doc_id // 10, doc_id) AS path, concat_ws('/', lang, source, doc_id // 10) AS folder FROM documents),
        rest AS (SELECT path, folder, sha256(replace(text, '$', ' ')) AS sha256 FROM files f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND toxic = 1)),
        was AS (SELECT path, folder, sha256(text) AS sha256 FROM files)"""
_ABOVE = "SELECT *, unnest(list_transform(range(0, len(string_split(folder, '/')) + 1), lambda k: array_to_string(string_split(folder, '/')[1:k], '/'))) AS top"

_SINGLE, _PLAIN, _SEVERAL = S.nfkd_ascii()
_TABLE = f"map([{', '.join(f"'{c}'" for c in _SEVERAL)}], [{', '.join("'" + p.replace("'", "''") + "'" for p in _SEVERAL.values())}])"

ORACLE_SQL = {
    "span_scan": f"WITH {_LINKS} SELECT page_id, i, dest, start_b FROM links WHERE i > 0",
    "shared_refs": f"WITH {_LINKS} SELECT dest, count(DISTINCT page_id) AS n_docs, count(*) AS n_refs FROM links WHERE i > 0 GROUP BY dest HAVING count(DISTINCT page_id) > 1",
    "dup_sha": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "secret_lines": r"""SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE regexp_matches(line, '(?i)(api[_-]?key|secret|token|password)[[:space:]]*[:=][[:space:]]*[''"][^$<{][^''"]+') GROUP BY doc_id""",
    "category_rollup": "SELECT lang, source, count(*) AS n, CAST(grouping(lang, source) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (lang, source)",
    "unmatched_anti": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "unmatched_beside_semi": """SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
        AND EXISTS (SELECT 1 FROM documents e JOIN labels l ON l.doc_id = e.doc_id AND l.toxic = 1 WHERE e.source = d.source AND e.lang = d.lang)""",
    "metadata_left": "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "sequence_numbers": """SELECT doc_id, n AS seq, 'fig' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS name
        FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)""",
    "evidence_top1": """SELECT source, doc_id, CAST(tier AS BIGINT) AS tier FROM (
        SELECT source, doc_id, tier, row_number() OVER (PARTITION BY source ORDER BY tier, n_chars DESC, doc_id) AS r FROM (
          SELECT d.source, d.doc_id, d.n_chars, CASE WHEN l.quality = 1 THEN 1 WHEN l.toxic = 1 THEN 2 WHEN l.quality IS NOT NULL THEN 3 ELSE 4 END AS tier
          FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)) WHERE r = 1""",
    "cache_keys": "SELECT doc_id, sha256(sha256(text) || chr(0) || 'model' || chr(0) || '1') AS cache_key, left(sha256(text), 8) AS hash8 FROM documents",
    "ascii_slugs": r"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents",
    "nfkd_slugs": rf"""WITH m AS (SELECT {_TABLE} AS m), t AS (
          SELECT doc_id, text, regexp_extract_all(translate(text, '{_SINGLE}', '{_PLAIN.replace("'", "''")}'), '[^\x00-\x7F]|[\x00-\x7F]+') AS runs FROM documents),
        a AS (SELECT doc_id, text, array_to_string(list_transform(runs, lambda c: CASE WHEN regexp_matches(c, '^[\x00-\x7F]') THEN c ELSE coalesce(map_extract_value(m, c), '') END), '') AS plain FROM t, m),
        s AS (SELECT doc_id, text, trim(regexp_replace(lower(plain), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM a)
        SELECT doc_id, rtrim(left(CASE WHEN slug IN ('', {', '.join(f"'{r}'" for r in S.RESERVED)}) THEN 'asset' ELSE slug END, 80 - 13), '-') || '-' || left(sha256(text), 8) || '.png' AS name FROM s""",
    "decoded_links": f"WITH {_LINKS} SELECT page_id, i, url_decode(dest) AS decoded, regexp_matches(dest, '^[A-Za-z][A-Za-z0-9+.-]*:') AS remote FROM links WHERE i > 0",
    "oversize": "SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) > 20000",
    "parity_full_outer": """WITH a AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1),
        b AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY 1)
        SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, -1) AS left_value, coalesce(b.n, -1) AS right_value
        FROM a FULL JOIN b ON a.source = b.source WHERE a.n IS DISTINCT FROM b.n""",
    "asof_heading": """SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS heading FROM conversations""",
    "adjacent_caption": """SELECT conv_id, turn, coalesce(lag(length(text)) OVER w, -1) AS before, coalesce(lead(length(text)) OVER w, -1) AS after
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "outside_ranges": f"""WITH {_LINKS}, parts AS (
          SELECT page_id, unnest(p) AS part, CAST(unnest(range(len(p))) AS BIGINT) AS k FROM (SELECT page_id, string_split(html, '<ul>') AS p FROM pages)),
        ranges AS (SELECT page_id, k, lo, lo + strlen(split_part(part, '</li>', 1)) AS hi FROM (
          SELECT page_id, k, part, sum(strlen(part) + 4) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo FROM parts) WHERE k > 0)
        SELECT page_id, i, start_b FROM links l WHERE i > 0 AND NOT EXISTS (SELECT 1 FROM ranges r WHERE r.page_id = l.page_id AND l.start_b >= r.lo AND l.start_b < r.hi)""",
    "block_lines": """WITH t AS (
          SELECT CAST(conv_id AS VARCHAR) AS doc_path, turn, unnest(range(CASE role WHEN 'user' THEN CASE WHEN turn % 4 = 0 THEN 2 ELSE 1 END WHEN 'assistant' THEN 4 ELSE 2 END)) AS k, role FROM conversations),
        l AS (SELECT doc_path, 4 * turn + k AS line, role = 'assistant' OR (role <> 'user' AND k = 1) AS protected,
              CASE WHEN role = 'user' AND k = 0 THEN 'Turn ' || turn END AS heading FROM t)
        SELECT doc_path, line, protected, coalesce(heading, '') AS heading,
          coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS nearest FROM l""",
    "tree_changes": """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256 FROM documents),
        b AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(replace(text, chr(10), ' ')) AS sha256 FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
        SELECT *, 'before' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'after' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "path_counts": f"""WITH {_FILES} SELECT top AS folder, CASE WHEN top = '' THEN 0 ELSE len(string_split(top, '/')) END AS depth, count(*) AS n
        FROM ({_ABOVE} FROM was) GROUP BY top""",
    "folder_changes": f"""WITH {_FILES}, differ AS ((SELECT * FROM was EXCEPT ALL SELECT * FROM rest) UNION ALL (SELECT * FROM rest EXCEPT ALL SELECT * FROM was)),
        tops AS (SELECT DISTINCT top FROM ({_ABOVE} FROM differ)),
        a AS (SELECT top, count(*) AS n FROM ({_ABOVE} FROM was) GROUP BY top), b AS (SELECT top, count(*) AS n FROM ({_ABOVE} FROM rest) GROUP BY top)
        SELECT tops.top AS folder, a.n AS n_before, coalesce(b.n, 0) AS n_after, CASE WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS status
        FROM tops JOIN a ON a.top = tops.top LEFT JOIN b ON b.top = tops.top""",
    "changed_files": f"""WITH {_FILES} SELECT path, sha256, 'before' AS side FROM (SELECT path, sha256 FROM was EXCEPT ALL SELECT path, sha256 FROM rest)
        UNION ALL SELECT path, sha256, 'after' AS side FROM (SELECT path, sha256 FROM rest EXCEPT ALL SELECT path, sha256 FROM was)""",
    "declared_counts": """SELECT CAST(conv_id AS VARCHAR) AS doc_path, 'turn ' || turn AS name, length(text) AS n FROM (
          SELECT *, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM conversations) WHERE role = 'assistant' AND before = 'user'""",
    "checked_links": """WITH t AS (SELECT conv_id, turn, role, 'c/' || conv_id || '.md' AS doc_path, 'c/' || (conv_id + 1) || '.md' AS after FROM conversations),
        heads AS (SELECT conv_id, turn % 3 AS m, count(*) AS n FROM t WHERE role = 'user' GROUP BY ALL),
        l AS (SELECT doc_path, 2 * turn AS line, unnest(range(4)) AS k, conv_id, turn, after FROM t WHERE role = 'assistant'
              UNION ALL SELECT doc_path, 2 * turn, 0, NULL, turn, NULL FROM t WHERE role NOT IN ('user', 'assistant'))
        SELECT doc_path, line, k, CASE WHEN conv_id IS NULL THEN 'none.md' WHEN k = 0 THEN '#turn-' || turn % 3 || '-1' WHEN k = 1 THEN '../' || after WHEN k = 2 THEN '../../' || turn || '.md' ELSE after[3:] END AS raw_destination,
          conv_id IS NULL OR k = 3 AS in_code, CASE WHEN conv_id IS NULL THEN 'c/none.md' WHEN k = 0 THEN doc_path WHEN k = 2 THEN '' ELSE after END AS target,
          CASE WHEN conv_id IS NULL THEN 'no file' WHEN k = 2 THEN 'outside' WHEN k = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM heads h WHERE h.conv_id = l.conv_id AND m = turn % 3 AND n > 1) THEN 'ok' ELSE 'no heading' END
               WHEN EXISTS (SELECT 1 FROM t WHERE t.doc_path = l.after) THEN 'ok' ELSE 'no file' END AS status FROM l""",
    "name_collisions": "SELECT lower(concat_ws('-', upper(lang), n_chars)) AS target, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "summary_counts": """SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(*) FILTER (quality IS NULL) AS missing, count(*) FILTER (toxic = 1) AS warnings
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "utf8_count": "SELECT count(*) FILTER (NOT contains(text, chr(65533))) AS n_text FROM documents",
    "rewrite_spans": r"""SELECT page_id, sha256(new) AS sha256, strlen(new) AS n_bytes FROM (
        SELECT page_id, parts[1] || list_aggregate(list_transform(range(2, len(parts) + 1), lambda k: '<a href="#' || (k - 1) || substr(parts[k], instr(parts[k], '"'))), 'string_agg', '') AS new
        FROM (SELECT page_id, string_split(html, '<a href="') AS parts FROM pages) WHERE len(parts) > 1)""",
}
