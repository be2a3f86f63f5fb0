"""Queries that run the index operators over the given tables, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import content_hash, project_identity, row_id, within_size
from ..functions.routing import LANGUAGES, WALK_SKIP, route_language, skipped
from ..functions.text import is_blank, lines_keepends, newlines, without_end
from ..functions.tokenizers import bpe_counter
from ..functions.vectors import similarity
from ..operators.code import parse_files
from ..operators.diff import fingerprints_differ, plan_diff, plan_status
from ..operators.markdown import clean_title, fenced_flags, heading_paths, headings, numbered_lines, sections
from ..operators.packing import pack_long
from ..operators.search import embed_one, hash_embedding, path_filter, top_k, top_k_batch
from ..operators.slicing import char_slices, compose, prepare, token_slices
from ..operators.windows import overlapping_windows, uncovered
from ..tables import latest, spread, table
from .render import hit_fields, hit_text

# --- tables without deliveries counted twice ------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_file").dropDuplicates(["file_path"])


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk").dropDuplicates(["chunk_id"])


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stored_row").dropDuplicates(["id"])


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repository, committed or uncommitted build, and file: the delivery received last."""
    rows = table(spark, sf_dir, "active_index").withColumn("sha256", F.lower("sha256"))
    order = [F.col("received_at").desc_nulls_last(), F.col("sha256").desc_nulls_last(), F.col("chunks").desc_nulls_last()]
    return latest(rows, ["repo_dir", "snapshot_no", "relative_path"], order)


def _two_builds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files of the last committed build of each repository, and of the one before it."""
    w = Window.partitionBy("repo_dir").orderBy(F.desc("snapshot_no"))
    builds = table(spark, sf_dir, "build_log").where("status = 'active'").select("repo_dir", "snapshot_no").distinct().withColumn("age", F.row_number().over(w))
    rows = _index(spark, sf_dir).join(builds, ["repo_dir", "snapshot_no"])
    pick = lambda n: rows.where(F.col("age") == n).select("repo_dir", "relative_path", "sha256", "chunks")
    return pick(1), pick(2)


_F = "(SELECT DISTINCT ON (file_path) * FROM source_file)"
_C = "(SELECT DISTINCT ON (chunk_id) * FROM chunk)"
_S = "(SELECT DISTINCT ON (id) * FROM stored_row)"
_I = """(SELECT * REPLACE (lower(sha256) AS sha256) FROM active_index QUALIFY row_number() OVER (
  PARTITION BY repo_dir, snapshot_no, relative_path
  ORDER BY received_at DESC NULLS LAST, lower(sha256) DESC NULLS LAST, chunks DESC NULLS LAST) = 1)"""
_B = f"""b AS (SELECT repo_dir, snapshot_no, row_number() OVER (PARTITION BY repo_dir ORDER BY snapshot_no DESC) AS age
  FROM (SELECT DISTINCT repo_dir, snapshot_no FROM build_log WHERE status = 'active')),
  i AS (SELECT x.repo_dir, x.relative_path, x.sha256, x.chunks, b.age FROM {_I} x JOIN b USING (repo_dir, snapshot_no)),
  new AS (SELECT * FROM i WHERE age = 1), old AS (SELECT * FROM i WHERE age = 2)"""
_BLANK = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL it is checked against."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# --- sources, identities, routing -----------------------------------------------------------------


@query(f"SELECT file_path, sha256(content) AS digest, lower(sha256) = sha256(content) AS same FROM {_F}")
def content_hash_files(spark, sf_dir):
    """The hash of every file's content, and whether it is the delivered one."""
    digest = content_hash(F.col("content"))
    return _files(spark, sf_dir).select("file_path", digest.alias("digest"), (F.lower("sha256") == digest).alias("same"))


@query(
    """SELECT repo_dir, coalesce(nullif(regexp_extract(rtrim(repo_dir, '/'), '([^/]*)$', 1), ''), 'root') || '-' || sha256(repo_dir)[1:16] AS identity,
    count(*) AS files FROM source_file GROUP BY repo_dir"""
)
def project_identities(spark, sf_dir):
    """Identity of every repository with files, and its delivered files."""
    return table(spark, sf_dir, "source_file").groupBy("repo_dir").agg(F.count("*").alias("files")).select("repo_dir", project_identity(F.col("repo_dir")).alias("identity"), "files")


@query(
    f"""SELECT id, sha256(metadata.relative_path || chr(0) || metadata.file_sha256 || chr(0) || metadata.chunk_ordinal) AS row_id
    FROM {_S}"""
)
def row_ids(spark, sf_dir):
    """Stable ids of the stored slices."""
    m = "metadata."
    return _stored(spark, sf_dir).select("id", row_id(F.col(m + "relative_path"), F.col(m + "file_sha256"), F.col(m + "chunk_ordinal")).alias("row_id"))


@query(f"SELECT file_path, strlen(content) AS bytes, strlen(content) <= 1048576 AS fits FROM {_F}")
def size_guard(spark, sf_dir):
    """Whether a file is small enough to be indexed."""
    return _files(spark, sf_dir).select("file_path", F.octet_length("content").cast("bigint").alias("bytes"), within_size(F.col("content")).alias("fits"))


def _skip_sql(language) -> str:
    dirs = ", ".join(f"'{d}'" for d in language.skip_dirs)
    names = "|".join(f"(?:{n})" for n in language.skip_names)
    exts = ", ".join(f"'{e}'" for e in language.extensions)
    return f"""(lower(regexp_extract(relative_path, '[^/]\\.([^./]+)$', 1)) NOT IN ({exts})
      OR len(list_intersect(list_transform(string_split(relative_path, '/'), lambda x: lower(x)), [{dirs}])) > 0
      OR regexp_matches(list_last(string_split(relative_path, '/')), '(?i){names}'))"""


_ROUTE = "CASE " + " ".join(f"WHEN NOT {_skip_sql(x)} THEN '{x.name}'" for x in LANGUAGES) + " END"


@query(f"SELECT file_path, {_ROUTE} AS reads FROM {_F}")
def route_files(spark, sf_dir):
    """Which language reads each file, if any."""
    return _files(spark, sf_dir).select("file_path", route_language(F.col("relative_path")).alias("reads"))


@query(f"SELECT file_path, {', '.join(f'{_skip_sql(x)} AS {x.name}_skips' for x in LANGUAGES)} FROM {_F}")
def skip_rules(spark, sf_dir):
    """Which languages leave each file alone."""
    return _files(spark, sf_dir).select("file_path", *[skipped(F.col("relative_path"), x).alias(f"{x.name}_skips") for x in LANGUAGES])


@query(
    f"""SELECT repo_dir, {_ROUTE} AS reads, count(*) AS files, sum(strlen(content)) AS bytes FROM {_F}
    WHERE strlen(content) <= 1048576 AND len(list_intersect(list_transform(string_split(relative_path, '/'), lambda x: lower(x)), [{', '.join(f"'{d}'" for d in WALK_SKIP)}])) = 0
    AND {_ROUTE} IS NOT NULL GROUP BY 1, 2"""
)
def collected_files(spark, sf_dir):
    """Files a walk over each repository collects, by language."""
    parts = F.transform(F.split("relative_path", "/"), F.lower)
    walked = ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in WALK_SKIP]))
    found = _files(spark, sf_dir).where(within_size(F.col("content")) & walked).withColumn("reads", route_language(F.col("relative_path")))
    return found.where("reads is not null").groupBy("repo_dir", "reads").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


# --- text -----------------------------------------------------------------------------------------


@query(
    f"""SELECT file_path, w AS window_no, 1 + length(left(content, w * 1800)) - length(replace(left(content, w * 1800), chr(10), '')) AS start_line,
      1 + length(left(content, w * 1800 + 2000)) - length(replace(left(content, w * 1800 + 2000), chr(10), '')) AS end_line,
      substr(content, w * 1800 + 1, 2000) AS body
    FROM (SELECT file_path, content, unnest(range(CAST(ceil(length(content) / 1800) AS BIGINT))) AS w FROM {_F} WHERE length(content) > 0)
    WHERE regexp_matches(body, '{_BLANK}')"""
)
def windows_overlap(spark, sf_dir):
    """Overlapping windows over all files."""
    return overlapping_windows(_files(spark, sf_dir), keep=["file_path"], text="content")


@query(
    f"""WITH n AS (SELECT file_path, start_line - 1 AS s, end_line AS e FROM {_C} WHERE type <> 'other' AND file_path IS NOT NULL),
    x AS (SELECT file_path, max(end_line) AS extent FROM {_C} WHERE file_path IS NOT NULL GROUP BY 1),
    g AS (SELECT file_path, coalesce(max(e) OVER (PARTITION BY file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start, s AS gap_end FROM n
      UNION ALL SELECT x.file_path, coalesce((SELECT max(e) FROM n WHERE n.file_path = x.file_path), 0), extent FROM x)
    SELECT * FROM g WHERE gap_start < gap_end"""
)
def gap_complement(spark, sf_dir):
    """Lines of each file that no symbol covers, as half-open ranges from 0."""
    chunks = _chunks(spark, sf_dir).where("file_path is not null")
    spans = chunks.where("type <> 'other'").select("file_path", (F.col("start_line") - 1).alias("s"), F.col("end_line").alias("e"))
    extents = chunks.groupBy("file_path").agg(F.max("end_line").alias("extent"))
    return uncovered(spans, extents, key=["file_path"], start="s", end="e", extent="extent")


_LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"


@query(
    f"""SELECT chunk_id, len(regexp_extract_all(body, '\\r\\n|[{_LINE_ENDS}]')) + CASE WHEN regexp_matches(body, '[^{_LINE_ENDS}]\\z') THEN 1 ELSE 0 END AS lines,
    length(body) AS chars, NOT regexp_matches(body, '{_BLANK}') AS blank FROM {_C}"""
)
def lines_of_all_chunks(spark, sf_dir):
    """Lines and characters of every chunk, however its lines end."""
    body = F.col("body")
    return _chunks(spark, sf_dir).select("chunk_id", F.size(lines_keepends(body)).cast("bigint").alias("lines"), F.char_length(body).cast("bigint").alias("chars"), is_blank(body).alias("blank"))


@query(SQL["lines_of_all_chunks"])
def lines_of_chunks(spark, sf_dir):
    """The same under its first name; no chunk is left out."""
    return lines_of_all_chunks(spark, sf_dir)


@query(
    f"""SELECT file_path, sha256(content) AS digest, length(content) AS chars,
    len(regexp_extract_all(content, '\\r\\n|[{_LINE_ENDS}]')) + CASE WHEN regexp_matches(content, '[^{_LINE_ENDS}]\\z') THEN 1 ELSE 0 END AS lines
    FROM {_F} WHERE content IS NOT NULL"""
)
def lines_rejoin(spark, sf_dir):
    """Joining the lines of every file gives the file, and there are as many as line ends and rests."""
    lines = lines_keepends(F.col("content"))
    rejoined = F.array_join(lines, "")
    return (
        _files(spark, sf_dir).where("content is not null")
        .select("file_path", F.sha2(rejoined, 256).alias("digest"), F.char_length(rejoined).cast("bigint").alias("chars"), F.size(lines).cast("bigint").alias("lines"))
    )


# --- Markdown -------------------------------------------------------------------------------------

_L = f"""l AS (SELECT file_path, u.i AS line_no, u.t AS line FROM (SELECT file_path,
    unnest(list_transform(range(1, len(string_split(content, chr(10))) + 1), lambda i: {{'i': i, 't': rtrim(string_split(content, chr(10))[i], chr(13))}})) AS u, content
    FROM {_F} WHERE language = 'markdown' AND regexp_matches(content, '{_BLANK}')) WHERE NOT (u.t = '' AND u.i = len(string_split(content, chr(10)))))"""
_FENCED = f"""{_L},
  f AS (SELECT *, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})(.*)$', 1) AS mark, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})(.*)$', 2) AS rest FROM l),
  z AS (SELECT * FROM f WHERE mark <> ''),
  zn AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS k FROM z),
  st AS (WITH RECURSIVE r AS (
      SELECT file_path, 0 AS k, 0 AS line_no, '' AS open FROM (SELECT DISTINCT file_path FROM l)
      UNION ALL
      SELECT r.file_path, n.k, n.line_no, CASE WHEN r.open = '' AND NOT (n.mark[1] = '`' AND contains(n.rest, '`')) THEN n.mark
          WHEN r.open <> '' AND starts_with(n.mark, r.open) AND trim(n.rest, chr(32) || chr(9)) = '' THEN '' ELSE r.open END
      FROM r JOIN zn n ON n.file_path = r.file_path AND n.k = r.k + 1) SELECT * FROM r),
  m AS (SELECT l.file_path, l.line_no, l.line,
      (SELECT arg_max(st.open, st.k) FROM st WHERE st.file_path = l.file_path AND st.line_no < l.line_no) <> ''
      OR (SELECT arg_max(st.open, st.k) FROM st WHERE st.file_path = l.file_path AND st.line_no <= l.line_no) <> '' AS fenced FROM l)"""
_TITLE = "coalesce(nullif(trim(regexp_replace(trim({0}, chr(32) || chr(9) || chr(13)), '\\s+', ' ', 'g'), '`*_ '), ''), '<untitled>')"
_HEADS = f"""{_FENCED},
  h0 AS (SELECT *, NOT fenced AND regexp_matches(line, '^(#{{1,6}})[ \\t]+(.+?)[ \\t]*#*[ \\t]*$') AS atx,
      lead(line) OVER w AS nl, lead(fenced) OVER w AS nf FROM m WINDOW w AS (PARTITION BY file_path ORDER BY line_no)),
  h AS (SELECT file_path, line_no, CASE WHEN atx THEN length(regexp_extract(line, '^(#{{1,6}})[ \\t]+(.+?)[ \\t]*#*[ \\t]*$', 1)) WHEN contains(nl, '=') THEN 1 ELSE 2 END AS level,
      {_TITLE.format("CASE WHEN atx THEN regexp_extract(line, '^(#{1,6})[ ' || chr(9) || ']+(.+?)[ ' || chr(9) || ']*#*[ ' || chr(9) || ']*$', 2) ELSE line END")} AS title
    FROM h0 WHERE atx OR (NOT fenced AND regexp_matches(line, '{_BLANK}') AND NOT coalesce(nf, true) AND regexp_matches(nl, '^[ \\t]*(=+|-+)[ \\t]*$')))"""


_PATHS = """a AS (SELECT h.*, p.title AS pt, p.line_no AS pn FROM h LEFT JOIN h p ON p.file_path = h.file_path AND p.line_no < h.line_no AND p.level < h.level
      AND NOT EXISTS (SELECT 1 FROM h q WHERE q.file_path = h.file_path AND q.line_no > p.line_no AND q.line_no < h.line_no AND q.level <= p.level)),
    hp AS (SELECT file_path, line_no, level, title, concat_ws(' > ', string_agg(pt, ' > ' ORDER BY pn), title) AS heading_path FROM a GROUP BY file_path, line_no, level, title)"""


def _markdown(spark, sf_dir):
    return _files(spark, sf_dir).where((F.col("language") == "markdown") & ~is_blank(F.col("content")))


@query(f"WITH {_FENCED} SELECT file_path, count(*) AS lines, sum(CASE WHEN fenced THEN 1 ELSE 0 END) AS fenced FROM m GROUP BY 1")
def md_fences(spark, sf_dir):
    """Lines of each Markdown file, and those in fenced blocks."""
    lines = numbered_lines(_markdown(spark, sf_dir), key="file_path", text="content")
    return lines.groupBy("file_path").agg(F.count("*").alias("lines"), F.sum(F.col("fenced").cast("int")).alias("fenced"))


@query(f"WITH {_HEADS} SELECT file_path, line_no, level, title FROM h")
def md_headings(spark, sf_dir):
    """Headings of all Markdown files."""
    return headings(numbered_lines(_markdown(spark, sf_dir), key="file_path", text="content"), key="file_path")


@query(f"WITH {_HEADS}, {_PATHS} SELECT file_path, line_no, level, title, heading_path FROM hp")
def md_heading_path(spark, sf_dir):
    """Headings with the path of the headings above them."""
    return heading_paths(_markdown(spark, sf_dir), key="file_path", text="content")


_SECTIONS = f"""WITH {_HEADS}, {_PATHS},
    w AS (SELECT file_path, u.i AS line_no, u.raw AS raw FROM (SELECT file_path, unnest(list_transform(range(1, len(string_split(content, chr(10))) + 1),
      lambda i: {{'i': i, 'raw': string_split(content, chr(10))[i] || CASE WHEN i < len(string_split(content, chr(10))) THEN chr(10) ELSE '' END}})) AS u
      FROM {_F} WHERE language = 'markdown' AND regexp_matches(content, '{_BLANK}')) WHERE u.raw <> ''),
    s AS (SELECT w.*, coalesce((SELECT max(hp.line_no) FROM hp WHERE hp.file_path = w.file_path AND hp.line_no <= w.line_no), 0) AS hl FROM w),
    g AS (SELECT file_path, hl, max(line_no) AS end_line, string_agg(raw, '' ORDER BY line_no) AS body, list_last(string_split(file_path, '/')) AS fname FROM s GROUP BY file_path, hl)
    SELECT g.file_path, greatest(hl, 1) AS start_line, end_line, coalesce(level, 0) AS level, coalesce(title, fname) AS title, coalesce(heading_path, fname) AS heading_path, body
    FROM g LEFT JOIN hp ON hp.file_path = g.file_path AND hp.line_no = g.hl WHERE hl > 0 OR regexp_matches(body, '{_BLANK}')"""


@query(_SECTIONS)
def md_sections(spark, sf_dir):
    """Sections of all Markdown files."""
    return sections(_markdown(spark, sf_dir), key="file_path", text="content", name=F.element_at(F.split("file_path", "/"), -1))




def _lines_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{_LINE_ENDS}]*(?:\\r\\n|[{_LINE_ENDS}])|[^{_LINE_ENDS}]+')"


_PACK = f"""WITH RECURSIVE sec AS ({_SECTIONS}),
  g AS (SELECT row_number() OVER () AS id, *, {_lines_sql('body')} AS ls FROM sec WHERE length(body) > 3000),
  l AS (SELECT *, list_transform(ls, lambda x: CAST(length(x) AS BIGINT)) AS n, list_transform(ls, lambda x: NOT regexp_matches(x, '{_BLANK}')) AS bl FROM g),
  r AS (
    SELECT id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS sz, CAST(-1 AS BIGINT) AS ca, CAST(-1 AS BIGINT) AS cb, CAST(-1 AS BIGINT) AS da, CAST(-1 AS BIGINT) AS db FROM l
    UNION ALL
    SELECT id, i + 1, CASE WHEN soft THEN i + 1 ELSE a2 END, CASE WHEN soft THEN 0 ELSE sz2 END, CASE WHEN closes THEN a ELSE -1 END, i,
      CASE WHEN ov THEN i WHEN soft THEN a2 ELSE -1 END, i + 1
    FROM (SELECT *, NOT ov AND blank AND sz2 >= 2400 AS soft, a < i AND (ov OR full_) AS closes
      FROM (SELECT *, CASE WHEN ov THEN i + 1 WHEN full_ THEN c ELSE a END AS a2, CASE WHEN ov THEN 0 WHEN full_ THEN coalesce(list_sum(n[c + 1:i]), 0) + k ELSE sz + k END AS sz2
        FROM (SELECT *, CASE WHEN coalesce(list_sum(n[greatest(a, i - 2) + 1:i]), 0) + k <= 3000 THEN greatest(a, i - 2)
              WHEN coalesce(list_sum(n[greatest(a, i - 1) + 1:i]), 0) + k <= 3000 THEN greatest(a, i - 1) ELSE i END AS c
          FROM (SELECT r.id, r.i, r.a, r.sz, l.n, l.n[r.i + 1] AS k, l.n[r.i + 1] > 3000 AS ov, r.a < r.i AND r.sz + l.n[r.i + 1] > 3000 AS full_, l.bl[r.i + 1] AS blank
            FROM r JOIN l USING (id) WHERE r.i < len(l.ls)))))),
  p AS (SELECT id, i, 0 AS o, ca AS a, cb AS b FROM r WHERE ca >= 0 UNION ALL SELECT id, i, 1, da, db FROM r WHERE da >= 0
    UNION ALL SELECT r.id, r.i, 2, r.a, len(l.ls) FROM r JOIN l USING (id) WHERE r.i = len(l.ls) AND r.a < r.i AND list_contains(l.bl[r.a + 1:], false)),
  t AS (SELECT p.*, l.file_path, l.title, l.heading_path, l.start_line AS l0, array_to_string(l.ls[p.a + 1:p.b], '') AS txt FROM p JOIN l USING (id)),
  u AS (SELECT *, unnest(range(CAST(ceil(length(txt) / 3000.0) AS BIGINT))) AS k FROM t)
SELECT file_path, title, heading_path, CAST(row_number() OVER (PARTITION BY id ORDER BY i, o, k) AS INT) AS part, CAST(l0 + a AS INT) AS start_line, CAST(l0 + b - 1 AS INT) AS end_line,
  substr(txt, k * 3000 + 1, 3000) AS body FROM u
UNION ALL SELECT file_path, title, heading_path, 0, CAST(start_line AS INT), CAST(start_line + greatest(len({_lines_sql('body')}), 1) - 1 AS INT), body FROM sec WHERE length(body) <= 3000"""


@query(_PACK)
def md_pack_lines(spark, sf_dir):
    """Sections packed into chunks of at most 3000 characters."""
    return pack_long(md_sections(spark, sf_dir), keep=["file_path", "title", "heading_path"], text="body", first_line="start_line")


@query(f"SELECT chunk_id, {_TITLE.format('signature')} AS title FROM {_C} WHERE language = 'markdown' AND signature IS NOT NULL")
def md_title_clean(spark, sf_dir):
    """Titles of Markdown sections without marks."""
    return _chunks(spark, sf_dir).where("language = 'markdown' and signature is not null").select("chunk_id", clean_title(F.col("signature")).alias("title"))


@query(
    f"""WITH d AS (SELECT doc_id, {_lines_sql('text')} AS ls FROM documents WHERE contains(text, repeat('`', 3)) OR contains(text, '~~~')),
  l AS (SELECT doc_id, i, regexp_replace(ls[i], '(?:\\r\\n|[{_LINE_ENDS}])\\z', '') AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
  z AS (SELECT *, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})((?s).*)$', 1) AS mark, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})((?s).*)$', 2) AS rest FROM l),
  m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM z WHERE mark <> ''),
  st AS (WITH RECURSIVE r AS (
      SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS i, '' AS open FROM d
      UNION ALL
      SELECT r.doc_id, m.k, m.i, CASE WHEN r.open = '' AND NOT (m.mark[1] = '`' AND contains(m.rest, '`')) THEN m.mark
          WHEN r.open <> '' AND starts_with(m.mark, r.open) AND trim(m.rest, chr(32) || chr(9)) = '' THEN '' ELSE r.open END
      FROM r JOIN m ON m.doc_id = r.doc_id AND m.k = r.k + 1) SELECT * FROM r),
  sp AS (SELECT doc_id, i AS a, lead(i) OVER (PARTITION BY doc_id ORDER BY k) AS b, open FROM st)
SELECT d.doc_id, CAST(len(d.ls) AS INT) AS lines,
  CAST(coalesce(sum(CASE WHEN sp.open <> '' THEN coalesce(sp.b, len(d.ls) + 1) - sp.a END), 0)
     + count(CASE WHEN sp.open <> '' AND nx.open = '' AND sp.b IS NOT NULL THEN 1 END) AS INT) AS fenced
FROM d JOIN sp USING (doc_id) LEFT JOIN sp nx ON nx.doc_id = sp.doc_id AND nx.a = sp.b GROUP BY d.doc_id, d.ls"""
)
def fenced_texts(spark, sf_dir):
    """Documents with fenced blocks: lines inside and in all."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("```")) | F.contains("text", F.lit("~~~")))
    flags = fenced_flags(F.transform(lines_keepends(F.col("text")), without_end))
    return docs.select("doc_id", F.size(flags).alias("lines"), F.size(F.filter(flags, lambda x: x)).alias("fenced"))


# --- code -----------------------------------------------------------------------------------------


def _symbols(language: str):
    def run(spark, sf_dir):
        files = _files(spark, sf_dir).where(F.col("language") == language)
        return parse_files(files, keep=["file_path", "repo_dir"], text="content", language="language", on_error="report")

    run.__name__ = f"{language}_symbols"
    run.__doc__ = f"Chunks of all {language} files: the text between symbols, then the symbols; a file that does not parse is one chunk that says so."
    return run


for _name in ("python", "go", "cpp"):
    query()(_symbols(_name))


# --- slicing --------------------------------------------------------------------------------------

_PARTS = f"""p AS (SELECT chunk_id, 'body' AS source_field, coalesce(body, '') AS t, start_line, end_line, language, signature FROM {_C}
    UNION ALL SELECT chunk_id, 'doc', doc, start_line, end_line, language, signature FROM {_C} WHERE length(doc) > 0),
  s AS (SELECT *, unnest(range(greatest(1, CAST(ceil(length(t) / 254) AS BIGINT)))) * 254 AS cs FROM p),
  q AS (SELECT *, substr(t, cs + 1, 254) AS piece, cs + length(substr(t, cs + 1, 254)) AS ce FROM s)"""


@query(f"WITH {_PARTS} SELECT chunk_id, source_field, CAST(cs AS INT) AS char_start, CAST(ce AS INT) AS char_end, piece, CAST(length(piece) + 2 AS INT) AS token_count FROM q")
def slices_char(spark, sf_dir):
    """Slices of all chunks under a budget of 256 character tokens."""
    return char_slices(_chunks(spark, sf_dir)).select("chunk_id", "source_field", "char_start", "char_end", "piece", "token_count")


@query(f"WITH {_PARTS} SELECT source_field, count(DISTINCT chunk_id) AS fields, count(*) AS slices, sum(length(piece)) AS chars, max(length(piece) + 2) AS most_tokens FROM q GROUP BY 1")
def slices_lossless(spark, sf_dir):
    """Slices add up to their fields."""
    cut = char_slices(_chunks(spark, sf_dir))
    return cut.groupBy("source_field").agg(
        F.count_distinct("chunk_id").alias("fields"), F.count("*").alias("slices"), F.sum(F.char_length("piece")).alias("chars"), F.max("token_count").alias("most_tokens")
    )


@query(
    f"""WITH {_PARTS} SELECT chunk_id, source_field, CAST(cs AS INT) AS char_start,
    CASE WHEN source_field = 'doc' THEN start_line ELSE coalesce(start_line, 1) + length(left(t, cs)) - length(replace(left(t, cs), chr(10), '')) END AS start_line,
    CASE WHEN source_field = 'doc' THEN end_line ELSE coalesce(start_line, 1) + length(left(t, greatest(cs, ce - 1))) - length(replace(left(t, greatest(cs, ce - 1)), chr(10), '')) END AS end_line,
    CASE WHEN source_field = 'doc' THEN 'associated_symbol' ELSE 'source' END AS line_range_kind FROM q"""
)
def slice_lines(spark, sf_dir):
    """Line ranges of all slices."""
    return prepare(_chunks(spark, sf_dir)).select("chunk_id", "source_field", "char_start", "start_line", "end_line", "line_range_kind")


_COMPOSE = """CASE WHEN language = 'markdown' THEN '# Section: ' ELSE '// Signature: ' END || signature || chr(10)"""


@query(
    f"""WITH {_PARTS}, c AS (SELECT *, {_COMPOSE} AS pre, length(coalesce(signature, '')) > 0 AS has FROM q),
    d AS (SELECT *, has AND length(pre) + 2 <= 64 AND length(pre) + length(piece) + 2 <= 256 AS fits FROM c)
    SELECT chunk_id, source_field, CAST(cs AS INT) AS char_start, CASE WHEN fits THEN pre || piece ELSE piece END AS document,
    CASE WHEN has AND NOT coalesce(fits, false) THEN 'signature' ELSE '' END AS context_omitted FROM d"""
)
def compose_context(spark, sf_dir):
    """Embedded texts: slices with a context line where it fits."""
    return compose(char_slices(_chunks(spark, sf_dir))).select("chunk_id", "source_field", "char_start", "document", "context_omitted")


@query(f"SELECT chunk_id, type AS associated_type, CAST(ceil(length(doc) / 254) AS BIGINT) AS slices FROM {_C} WHERE length(doc) > 0")
def doc_comment_rows(spark, sf_dir):
    """Comment rows of documented chunks."""
    rows = prepare(_chunks(spark, sf_dir)).where("type = 'comment' and source_field = 'doc'")
    return rows.groupBy("chunk_id", "associated_type").agg(F.count("*").alias("slices"))


@query()
def slices_tokens(spark, sf_dir):
    """Slices of all chunks under a budget of 256 tokens of a public subword tokenizer."""
    chunks = spread(_chunks(spark, sf_dir).select("chunk_id", "body", "doc"))
    return token_slices(chunks, bpe_counter()).select("chunk_id", "source_field", "char_start", "char_end", "token_count")


# --- planning and building ------------------------------------------------------------------------


@query(
    f"""WITH {_B} SELECT coalesce(n.repo_dir, o.repo_dir) AS repo_dir, coalesce(n.relative_path, o.relative_path) AS relative_path,
    CASE WHEN o.repo_dir IS NULL THEN 'A' WHEN n.repo_dir IS NULL THEN 'D' ELSE 'M' END AS change
    FROM new n FULL JOIN old o ON n.repo_dir = o.repo_dir AND n.relative_path = o.relative_path WHERE n.sha256 IS DISTINCT FROM o.sha256"""
)
def plan_changes(spark, sf_dir):
    """Changes of content between the last two committed builds of every repository."""
    new, old = _two_builds(spark, sf_dir)
    return plan_diff(new, old, key=["repo_dir", "relative_path"], digest="sha256")


@query(
    f"""WITH {_B}, d AS (SELECT coalesce(n.repo_dir, o.repo_dir) AS repo_dir, count(*) AS c FROM new n FULL JOIN old o
      ON n.repo_dir = o.repo_dir AND n.relative_path = o.relative_path WHERE n.sha256 IS DISTINCT FROM o.sha256 GROUP BY 1),
    cur AS (SELECT map_extract_value(fingerprint, 'parser') AS parser FROM projects ORDER BY repo_dir LIMIT 1),
    x AS (SELECT p.repo_dir, coalesce(d.c, 0) AS changes, map_extract_value(p.fingerprint, 'parser') IS DISTINCT FROM cur.parser AS other, NOT EXISTS (SELECT 1 FROM b WHERE b.repo_dir = p.repo_dir) AS first,
      NOT EXISTS (SELECT 1 FROM b WHERE b.repo_dir = p.repo_dir) AND EXISTS (SELECT 1 FROM build_log g WHERE g.repo_dir = p.repo_dir) AS migration
      FROM projects p CROSS JOIN cur LEFT JOIN d USING (repo_dir))
    SELECT repo_dir, changes, CASE WHEN migration THEN 'migration_required' WHEN first THEN 'first_build' WHEN other THEN 'fingerprint_changed' WHEN changes > 0 THEN 'content_changes' ELSE 'no_changes' END AS status,
    CASE WHEN migration OR first OR other THEN 'full' WHEN changes > 0 THEN 'incremental' ELSE 'skip' END AS mode FROM x"""
)
def plan_statuses(spark, sf_dir):
    """Status and recommended mode of every repository; the parser of the first one is taken for the current one."""
    log = table(spark, sf_dir, "build_log")
    seen = log.groupBy("repo_dir").agg(F.max((F.col("status") == "active").cast("int")).alias("committed"))
    counts = plan_changes(spark, sf_dir).groupBy("repo_dir").agg(F.count("*").alias("changes"))
    rows = table(spark, sf_dir, "projects").join(seen, "repo_dir", "left").join(counts, "repo_dir", "left")
    changes = F.coalesce("changes", F.lit(0))
    never = F.coalesce("committed", F.lit(0)) == 0
    current = table(spark, sf_dir, "projects").orderBy("repo_dir").select(F.col("fingerprint")["parser"].alias("p")).first()["p"]
    other = ~F.col("fingerprint")["parser"].eqNullSafe(F.lit(current))
    status, mode = plan_status(migration=never & F.col("committed").isNotNull(), first=never, parser_changed=other, changes=changes)
    return rows.select("repo_dir", changes.alias("changes"), status.alias("status"), mode.alias("mode"))


@query(
    """SELECT f.repo_dir, count(*) AS files, bool_or(map_entries(p.fingerprint) IS DISTINCT FROM map_entries(r.fingerprint)) AS differs FROM source_file f
    JOIN projects p ON p.repo_dir = f.repo_dir CROSS JOIN (SELECT fingerprint FROM projects ORDER BY repo_dir LIMIT 1) r GROUP BY 1"""
)
def fingerprint_mismatch(spark, sf_dir):
    """Repositories whose fingerprint differs from the first one's, with their delivered files."""
    projects = table(spark, sf_dir, "projects").select("repo_dir", "fingerprint")
    first = projects.orderBy("repo_dir").limit(1).first()["fingerprint"]
    expected = F.create_map(*[F.lit(x) for kv in sorted(first.items()) for x in kv])
    files = table(spark, sf_dir, "source_file").groupBy("repo_dir").agg(F.count("*").alias("files"))
    return files.join(projects, "repo_dir").select("repo_dir", "files", fingerprints_differ(F.col("fingerprint"), expected).alias("differs"))


@query(f"WITH {_B} SELECT repo_dir, relative_path FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.repo_dir = n.repo_dir AND o.relative_path = n.relative_path AND o.sha256 IS NOT DISTINCT FROM n.sha256)")
def changed_files(spark, sf_dir):
    """Files of the last build that must be parsed again."""
    new, old = _two_builds(spark, sf_dir)
    o = old.select(F.col("repo_dir").alias("r"), F.col("relative_path").alias("p"), F.col("sha256").alias("s"))
    return new.join(o, (F.col("repo_dir") == F.col("r")) & (F.col("relative_path") == F.col("p")) & F.col("sha256").eqNullSafe(F.col("s")), "left_anti").select("repo_dir", "relative_path")


@query(f"WITH {_B} SELECT repo_dir, relative_path FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE o.repo_dir = n.repo_dir AND o.relative_path = n.relative_path)")
def deleted_files(spark, sf_dir):
    """Files of the build before that are gone."""
    new, old = _two_builds(spark, sf_dir)
    return old.join(new, ["repo_dir", "relative_path"], "left_anti").select("repo_dir", "relative_path")


@query(
    f"""SELECT s.id, s.metadata.relative_path AS relative_path, s.metadata.chunk_ordinal AS chunk_ordinal FROM {_S} s
    WHERE EXISTS (SELECT 1 FROM source_file f WHERE f.repo_dir = s.repo_dir AND f.relative_path = s.metadata.relative_path AND lower(f.sha256) = lower(s.metadata.file_sha256))"""
)
def reused_rows(spark, sf_dir):
    """Stored rows whose file still has the content they were made from."""
    files = table(spark, sf_dir, "source_file").select("repo_dir", "relative_path", F.lower("sha256").alias("sha")).distinct()
    rows = _stored(spark, sf_dir).select("id", "repo_dir", F.col("metadata.relative_path").alias("relative_path"), F.col("metadata.chunk_ordinal").alias("chunk_ordinal"), F.lower("metadata.file_sha256").alias("sha"))
    return rows.join(files, ["repo_dir", "relative_path", "sha"], "left_semi").select("id", "relative_path", "chunk_ordinal")


@query(f"SELECT f.repo_dir, f.relative_path, count(c.chunk_id) AS chunks FROM {_F} f LEFT JOIN {_C} c ON c.file_path = f.file_path GROUP BY 1, 2")
def manifest_counts(spark, sf_dir):
    """Chunks of every file, files without chunks included."""
    counts = _chunks(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("n"))
    files = _files(spark, sf_dir).select("repo_dir", "relative_path", "file_path").join(counts, "file_path", "left")
    return files.groupBy("repo_dir", "relative_path").agg(F.sum(F.coalesce("n", F.lit(0))).alias("chunks"))


@query(
    f"""WITH i AS {_I} SELECT i.repo_dir, i.snapshot_no, count(*) AS files, sum(i.chunks) AS chunks, count(*) - count(i.chunks) AS unknown
    FROM i JOIN (SELECT DISTINCT repo_dir, snapshot_no FROM build_log WHERE status = 'active') b USING (repo_dir, snapshot_no) GROUP BY 1, 2"""
)
def count_reconcile(spark, sf_dir):
    """Files and chunks of every committed build."""
    builds = table(spark, sf_dir, "build_log").where("status = 'active'").select("repo_dir", "snapshot_no").distinct()
    rows = _index(spark, sf_dir).join(builds, ["repo_dir", "snapshot_no"])
    return rows.groupBy("repo_dir", "snapshot_no").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.count_if(F.col("chunks").isNull()).alias("unknown"))


@query(
    f"""WITH i AS {_I} SELECT repo_dir, snapshot_no, relative_path, NOT (relative_path = '' OR relative_path[1] = '/' OR list_contains(string_split(relative_path, '/'), '..')) AS path_ok,
    regexp_full_match(sha256, '[0-9a-f]{{64}}') AS sha_ok, coalesce(chunks >= 0, false) AS chunks_ok FROM i"""
)
def manifest_validate(spark, sf_dir):
    """Which records of the index state are well formed."""
    path = F.col("relative_path")
    ok = ~((path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), ".."))
    return _index(spark, sf_dir).select(
        "repo_dir", "snapshot_no", "relative_path", ok.alias("path_ok"), F.col("sha256").rlike("^[0-9a-f]{64}\\z").alias("sha_ok"), F.coalesce(F.col("chunks") >= 0, F.lit(False)).alias("chunks_ok")
    )


@query(
    f"""SELECT id, metadata.relative_path AS relative_path, metadata.type AS type, metadata.name AS name, metadata.start_line AS start_line, metadata.end_line AS end_line,
    metadata.token_count AS token_count, coalesce(metadata.source_text, document) AS source_text FROM {_S}"""
)
def metadata_projection(spark, sf_dir):
    """Flat metadata of the stored rows; only these fields are read."""
    m = [F.col(f"metadata.{c}").alias(c) for c in ("relative_path", "type", "name", "start_line", "end_line", "token_count")]
    return _stored(spark, sf_dir).select("id", *m, F.coalesce("metadata.source_text", "document").alias("source_text"))


# --- search ---------------------------------------------------------------------------------------


def _vector(spark, sf_dir):
    """The first vector of the table, as the query."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


_E = "1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_Q0 = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"SELECT e.vec_id, round({_E}, 6) AS distance, round(greatest(0, 1 - ({_E})), 6) AS similarity FROM embeddings e, {_Q0} q ORDER BY {_E}, vec_id LIMIT 10")
def topk_cosine(spark, sf_dir):
    """The ten vectors nearest to the first one."""
    found = top_k(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), k=10, id_="vec_id", embedding="embedding")
    return found.select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query(f"SELECT e.vec_id, round({_E}, 6) AS distance FROM embeddings e, {_Q0} q WHERE e.label % 2 = 1 ORDER BY {_E}, vec_id LIMIT 10")
def topk_filtered(spark, sf_dir):
    """The nearest vectors among those with an odd label: filtered before ranking."""
    found = top_k(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), k=10, id_="vec_id", embedding="embedding", where=F.col("label") % 2 == 1)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round({_E}, 9) AS distance FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, vec_id, round(distance, 6) AS distance FROM d
    QUALIFY rank <= 10"""
)
def topk_batch(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 50, against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    found = top_k_batch(rows.where("vec_id % 50 = 0"), rows, k=10, id_="vec_id", embedding="embedding")
    return found.withColumn("distance", F.round("distance", 6))


@query(f"SELECT metadata.file_path AS file_path, count(*) AS matches FROM {_S} WHERE contains(metadata.file_path, '/lib/') GROUP BY 1")
def filter_match_stats(spark, sf_dir):
    """Files, and rows of each, that a path fragment matches."""
    rows = _stored(spark, sf_dir).where(path_filter(F.col("metadata.file_path"), "/lib/"))
    return rows.groupBy(F.col("metadata.file_path").alias("file_path")).agg(F.count("*").alias("matches"))


@query(f"SELECT e.vec_id, round(greatest(0, 1 - ({_E})), 6) AS similarity FROM embeddings e, {_Q0} q")
def similarity_clamp(spark, sf_dir):
    """Similarities to the first vector; opposite vectors have none."""
    from ..functions.vectors import distance_to

    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(similarity(distance_to(F.col("embedding"), _vector(spark, sf_dir))), 6).alias("similarity"))


def _test_hits(spark, sf_dir) -> DataFrame:
    """Stored rows ranked by a vector that tells only whether a text names a target: exact in any engine."""
    flat = _stored(spark, sf_dir).select("id", "document", "metadata.*")
    return flat.withColumn("embedding", F.array(F.contains("document", F.lit("socket")).cast("double"), F.lit(1.0), F.lit(0.5)))


_HIT = f"""h AS (SELECT id, document, unnest(metadata), [CAST(CAST(contains(document, 'socket') AS INT) AS DOUBLE), 1.0, 0.5] AS v FROM {_S}),
  r AS (SELECT *, 1 - list_cosine_similarity(v, [1.0, 1.0, 0.5]::DOUBLE[]) AS distance FROM h ORDER BY round(distance, 12), id LIMIT 20)"""


@query(f"WITH h AS (SELECT id, [CAST(CAST(contains(document, 'socket') AS INT) AS DOUBLE), 1.0, 0.5] AS v FROM {_S}) SELECT id, v[1] AS target, v[2] AS one, v[3] AS half FROM h")
def embed_test_vectors(spark, sf_dir):
    """The vectors of the test provider."""
    return _test_hits(spark, sf_dir).select("id", F.col("embedding")[0].alias("target"), F.col("embedding")[1].alias("one"), F.col("embedding")[2].alias("half"))


@query(
    f"""WITH {_HIT} SELECT coalesce(file_path, '') AS file_path, coalesce(type, '') AS type, coalesce(name, '') AS name, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line,
    coalesce(line_range_kind, 'source') AS line_range_kind, coalesce(source_field, 'body') AS source_field, coalesce(char_start, 0) AS char_start, coalesce(char_end, 0) AS char_end,
    coalesce(source_field, 'body') AS char_offset_scope, coalesce(signature, '') AS signature, coalesce(language, 'unknown') AS language, round(greatest(0, 1 - distance), 6) AS similarity,
    coalesce(source_text, '') AS code FROM r"""
)
def hits_json_fields(spark, sf_dir):
    """The fields of the twenty best hits."""
    found = top_k(_test_hits(spark, sf_dir), [1.0, 1.0, 0.5], k=20, id_="id", embedding="embedding")
    return hit_fields(found).withColumn("similarity", F.round("similarity", 6))


_FENCE = "CASE WHEN language IN ('cpp', 'c', 'python', 'go', 'markdown') THEN language ELSE 'text' END"


@query(
    f"""WITH {_HIT}, n AS (SELECT *, row_number() OVER (ORDER BY round(distance, 12), id) AS rank FROM r)
    SELECT CAST(rank AS INT) AS rank, id, concat_ws(chr(10), '### ' || rank || '. ' || coalesce(nullif(name, ''), file_path), '- File: `' || file_path || '`', '- Type: ' || type, '- Language: ' || language,
      '- ' || CASE WHEN line_range_kind = 'associated_symbol' THEN 'Lines of the documented symbol' ELSE 'Lines' END || ': ' || start_line || '-' || end_line,
      '- Score: ' || printf('%.4f', greatest(0.0, 1 - distance)), CASE WHEN length(signature) > 0 THEN '- Signature: `' || signature || '`' END,
      chr(10) || '```' || {_FENCE} || chr(10) || coalesce(source_text, '') || chr(10) || '```' || chr(10)) AS block FROM n"""
)
def hits_text(spark, sf_dir):
    """The twenty best hits as text blocks."""
    found = top_k(_test_hits(spark, sf_dir), [1.0, 1.0, 0.5], k=20, id_="id", embedding="embedding")
    rank = F.row_number().over(Window.orderBy("distance", "id"))
    return found.withColumn("rank", rank).select("rank", "id", hit_text(F.col("rank")).alias("block"))


_QUESTION = "rotate the ledger before the next build"


def _codes(text: str) -> str:
    counts = f"list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: CAST('0x' || md5(w)[1:2] AS INT) % 64)"
    return f"list_transform(range(64), lambda k: CAST(len(list_filter({counts}, lambda c: c = k)) AS DOUBLE))"


@query(
    f"""WITH v AS (SELECT id, {_codes('document')} AS v FROM {_S} WHERE regexp_matches(document, '[\\p{{L}}\\p{{N}}_]')), q AS (SELECT {_codes(f"'{_QUESTION}'")} AS w),
    d AS (SELECT id, 1 - list_cosine_similarity(v, w) AS distance FROM v, q) SELECT id, round(distance, 6) AS distance FROM d ORDER BY d.distance, id LIMIT 20"""
)
def search_text(spark, sf_dir):
    """Index rows nearest to a question by the default embedding, ranked exactly."""
    documents = spread(table(spark, sf_dir, "stored_row").select("id", "document"))
    rows = documents.select("id", hash_embedding(F.col("document")).alias("embedding")).dropDuplicates(["id"])
    return top_k(rows, embed_one(spark, _QUESTION), k=20, id_="id", embedding="embedding").select("id", F.round("distance", 6).alias("distance"))


@query(f"SELECT language, type, count(*) AS chunks, sum(length(body)) AS chars, sum(length(body) - length(replace(body, chr(10), ''))) AS line_feeds FROM {_C} GROUP BY 1, 2")
def chunk_profile(spark, sf_dir):
    """Chunks, characters and line feeds by language and type."""
    return _chunks(spark, sf_dir).groupBy("language", "type").agg(F.count("*").alias("chunks"), F.sum(F.char_length("body")).alias("chars"), F.sum(newlines(F.col("body"))).alias("line_feeds"))
