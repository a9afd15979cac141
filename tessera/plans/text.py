"""Queries on text: slugs, colours, briefs, decisions, paths, tags, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up, half_up_sql
from tessera.plans import fixtures as X
from tessera.plans.registry import ORACLES, query


def slug(s: Column) -> Column:
    """Lower case, runs of other characters as one dash, one dash off each end, 60 characters, `art` for nothing."""
    t = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", "").substr(1, 60)
    return F.when(t == "", "art").otherwise(F.coalesce(t, F.lit("art")))


def _slug_sql(s: str) -> str:
    return f"coalesce(nullif(substr(regexp_replace(regexp_replace(lower({s}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60), ''), 'art')"


@query("slug_parts", f"SELECT p_partkey AS id, {_slug_sql(chr(39) + '  ' + chr(39) + ' || p_name || ' + chr(39) + ' #' + chr(39) + ' || p_brand')} AS slug FROM part")
def slug_parts(spark, sf):
    return X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), slug(F.concat(F.lit("  "), "p_name", F.lit(" #"), "p_brand")).alias("slug"))


@query("slug_urls", f"SELECT page_id AS id, {_slug_sql('url')} AS slug FROM pages")
def slug_urls(spark, sf):
    return X.table(spark, sf, "pages").select(F.col("page_id").alias("id"), slug(F.col("url")).alias("slug"))


# A colour in one of eight spellings, from a part's key.
_HEX = "lpad(printf('%x', (p_partkey * 7919) % 16777216), 6, '0')"
_SPELL = f"CASE p_partkey % 8 WHEN 0 THEN '#' || {_HEX} WHEN 1 THEN ' #' || substr({_HEX}, 1, 3) || ' ' WHEN 2 THEN '#' || upper({_HEX}) || '80' WHEN 3 THEN 'rgb(' || p_partkey % 256 || ', ' || p_size || ',7)' WHEN 4 THEN 'rgba(' || p_partkey % 256 || ' 3 4 / 50%)' WHEN 5 THEN '#' || substr({_HEX}, 1, 5) WHEN 6 THEN 'teal' ELSE '#' || substr({_HEX}, 1, 4) END"


def _spelt():
    k = F.col("p_partkey")
    h = F.lpad(F.lower(F.hex(k * 7919 % 16777216)), 6, "0")
    n = (k % 256).cast("string")
    forms = [F.concat(F.lit("#"), h), F.concat(F.lit(" #"), h.substr(1, 3), F.lit(" ")), F.concat(F.lit("#"), F.upper(h), F.lit("80")), F.concat(F.lit("rgb("), n, F.lit(", "), F.col("p_size").cast("string"), F.lit(",7)")), F.concat(F.lit("rgba("), n, F.lit(" 3 4 / 50%)")), F.concat(F.lit("#"), h.substr(1, 5)), F.lit("teal"), F.concat(F.lit("#"), h.substr(1, 4))]
    out = forms[-1]
    for i, f in reversed(list(enumerate(forms[:-1]))):
        out = F.when(k % 8 == i, f).otherwise(out)
    return out


RGB_TEXT = r"^rgba?\(\s*([\d.]+)[\s,]+([\d.]+)[\s,]+([\d.]+)(?:\s*[,/]\s*([\d.]+%?))?\s*\)$"


def parse_color(s: Column) -> Column:
    """A struct (r, g, b, a) of #rgb, #rgba, #rrggbb, #rrggbbaa, rgb() or rgba(); null for anything else."""
    t = F.lower(F.trim(s))
    raw = F.regexp_extract(t, "^#([0-9a-f]{3,8})$", 1)
    h = F.when(F.length(raw).isin(3, 4), F.regexp_replace(raw, "(.)", "$1$1")).otherwise(raw)
    pair = lambda i: F.conv(h.substr(i, 2), 16, 10).cast("long")
    part = F.regexp_extract(t, RGB_TEXT, 4)
    alpha = F.when(part == "", 1.0).when(part.endswith("%"), F.rtrim(F.translate(part, "%", "")).try_cast("double") / 100).otherwise(part.try_cast("double"))
    as_num = lambda i: F.floor(F.regexp_extract(t, RGB_TEXT, i).try_cast("double") + 0.5)
    hexed = F.struct(pair(1).alias("r"), pair(3).alias("g"), pair(5).alias("b"), F.when(F.length(h) == 8, pair(7) / 255.0).otherwise(1.0).alias("a"))
    called = F.struct(as_num(1).alias("r"), as_num(2).alias("g"), as_num(3).alias("b"), alpha.alias("a"))
    return F.when(F.length(h).isin(6, 8), hexed).when(t.rlike(RGB_TEXT), called)


@query(
    "parse_color",
    f"""WITH s AS (SELECT p_partkey AS id, lower(trim({_SPELL})) AS t FROM part), h AS (SELECT id, t, regexp_extract(t, '^#([0-9a-f]{{3,8}})$', 1) AS w FROM s),
    x AS (SELECT id, t, CASE WHEN length(w) IN (3, 4) THEN regexp_replace(w, '(.)', '\\1\\1', 'g') ELSE w END AS h, '^rgba?\\(\\s*([\\d.]+)[\\s,]+([\\d.]+)[\\s,]+([\\d.]+)(?:\\s*[,/]\\s*([\\d.]+%?))?\\s*\\)$' AS p FROM h)
    SELECT id, """
    + ", ".join(f"CASE WHEN length(h) IN (6, 8) THEN CAST('0x' || substr(h, {1 + 2 * i}, 2) AS BIGINT) WHEN regexp_matches(t, p) THEN CAST(floor(CAST(regexp_extract(t, '^rgba?\\(\\s*([\\d.]+)[\\s,]+([\\d.]+)[\\s,]+([\\d.]+)', {i + 1}) AS DOUBLE) + 0.5) AS BIGINT) END AS {c}" for i, c in enumerate("rgb"))
    + f""", {half_up_sql("CASE WHEN length(h) = 8 THEN CAST('0x' || substr(h, 7, 2) AS BIGINT) / 255.0::DOUBLE WHEN length(h) = 6 THEN 1 WHEN t LIKE 'rgba(%' THEN 0.5 WHEN t LIKE 'rgb(%' THEN 1 END", 4)} AS a FROM x""",
)
def parse_color_query(spark, sf):
    c = parse_color(_spelt())
    return X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), c.alias("c")).select("id", "c.r", "c.g", "c.b", half_up(F.col("c.a"), 4).alias("a"))


def normal_hex(s: Column) -> Column:
    """A colour as #rrggbb, whatever its spelling and alpha; null where it is no colour."""
    c = parse_color(s)
    two = lambda v: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), v)))), 2, "0")
    return F.when(c.isNotNull(), F.concat(F.lit("#"), *(two(c[n]) for n in "rgb")))


_NORMAL = " || ".join(f"lpad(printf('%x', greatest(0, least(255, {n}))), 2, '0')" for n in "rgb")


_HEX_SQL = f"SELECT id, CASE WHEN r IS NOT NULL THEN '#' || {_NORMAL} END AS hex FROM ({ORACLES['parse_color']}) q"


@query("normalize_hex", _HEX_SQL)
@query("normalize_hex_all", _HEX_SQL)
def normalize_hex_all(spark, sf):
    """Every part's colour in every spelling; null where it is no colour."""
    return X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), normal_hex(_spelt()).alias("hex"))


# A brief made of a part's columns.
_BRIEF = f"'# ' || p_name || chr(10) || '## Product' || chr(10) || p_name || ' by ' || p_brand || chr(10) || '## Palette notes' || chr(10) || 'Deep ' || p_type || ' #' || {_HEX} || ', pale ink: #abc, and #' || upper({_HEX}) || '.' || chr(10) || '### Rules' || chr(10) || '- Example: none' || chr(10) || '- keep ' || p_name || chr(10) || ' 2) no ' || p_brand || '  ' || chr(10) || 'plain line' || chr(10) || '* x'"


def brief():
    h = F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0")
    nl = F.lit("\n")
    return F.concat(
        F.lit("# "), "p_name", nl, F.lit("## Product\n"), "p_name", F.lit(" by "), "p_brand", nl, F.lit("## Palette notes\nDeep "), "p_type", F.lit(" #"), h, F.lit(", pale ink: #abc, and #"), F.upper(h),
        F.lit(".\n### Rules\n- Example: none\n- keep "), "p_name", F.lit("\n 2) no "), "p_brand", F.lit("  \nplain line\n* x"),
    )


def section(text: Column, name: str) -> Column:
    """The body of the section whose heading begins with the name, up to the next heading; empty without one."""
    body = F.regexp_extract(F.concat(text, F.lit("\n")), rf"(?ims)^#{{1,3}}\s*{name}\b[^\n]*\n(.*?)(?:^#{{1,3}}\s|\z)", 1)
    return F.regexp_replace(body, r"^\s+|\s+$", "")


@query("section_extract", f"SELECT p_partkey AS id, regexp_replace(regexp_extract({_BRIEF} || chr(10), '(?ims)^#{{1,3}}\\s*Product\\b[^\\n]*\\n(.*?)(?:^#{{1,3}}\\s|\\z)', 1), '^\\s+|\\s+$', '', 'g') AS product, regexp_replace(regexp_extract({_BRIEF} || chr(10), '(?ims)^#{{1,3}}\\s*Missing\\b[^\\n]*\\n(.*?)(?:^#{{1,3}}\\s|\\z)', 1), '^\\s+|\\s+$', '', 'g') AS missing FROM part")
def section_extract(spark, sf):
    return X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), section(brief(), "Product").alias("product"), section(brief(), "Missing").alias("missing"))


@query(
    "hex_palette",
    f"""WITH h AS (SELECT p_partkey AS id, list_transform(regexp_extract_all({_BRIEF}, '#([0-9a-fA-F]{{6}}|[0-9a-fA-F]{{3}})\\b', 1), lambda x: '#' || lower(CASE WHEN length(x) = 3 THEN regexp_replace(x, '(.)', '\\1\\1', 'g') ELSE x END)) AS l FROM part),
    u AS (SELECT id, unnest(l) AS hex, unnest(range(0, len(l))) AS pos FROM h), m AS (SELECT id, hex, min(pos) AS pos FROM u GROUP BY id, hex)
    SELECT id, hex, row_number() OVER (PARTITION BY id ORDER BY pos) AS place FROM m""",
)
def hex_palette(spark, sf):
    """Distinct colours of a brief in the order of first mention; array_distinct keeps that order within the row."""
    found = F.regexp_extract_all(brief(), F.lit(r"#([0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b"), F.lit(1))
    full = F.transform(found, lambda x: F.concat(F.lit("#"), F.lower(F.when(F.length(x) == 3, F.regexp_replace(x, "(.)", "$1$1")).otherwise(x))))
    d = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.array_distinct(full)).alias("p", "hex"))
    return d.select("id", "hex", (F.col("p") + 1).cast("long").alias("place"))


@query("decisions", f"WITH l AS (SELECT p_partkey AS id, string_split({_BRIEF}, chr(10)) AS l FROM part), u AS (SELECT id, unnest(l) AS line, unnest(range(0, len(l))) AS n FROM l), m AS (SELECT id, n, regexp_extract(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+(.*\\S)\\s*$', 1) AS decision FROM u WHERE regexp_matches(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+(.*\\S)\\s*$')) SELECT id, n AS line, decision FROM m WHERE NOT regexp_matches(decision, '(?i)^Example:')")
def decisions(spark, sf):
    """Bullet and numbered lines, examples left out."""
    mark = r"^\s*(?:[-*+]|\d+[.)])\s+(.*\S)\s*$"
    d = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.split(brief(), r"\r?\n")).alias("line", "t")).where(F.col("t").rlike(mark))
    d = d.select("id", F.col("line").cast("long").alias("line"), F.regexp_extract("t", mark, 1).alias("decision"))
    return d.where(~F.col("decision").rlike("(?i)^Example:"))


@query("brief_problems", f"SELECT p_partkey AS id, problem FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN length(regexp_replace(regexp_extract({_BRIEF} || chr(10), '(?ims)^#{{1,3}}\\s*Product\\b(.*?)(?:^#{{1,3}}\\s|\\z)', 1), '^\\s+|\\s+$', '', 'g')) < 24 THEN 'short Product' END, CASE WHEN NOT regexp_matches({_BRIEF}, '(?im)^#{{1,3}}\\s*Art direction\\b') THEN 'no Art direction' END], lambda x: x IS NOT NULL)) AS problem FROM part) q")
def brief_problems(spark, sf, least: int = 24):
    body = F.regexp_extract(F.concat(brief(), F.lit("\n")), r"(?ims)^#{1,3}\s*Product\b(.*?)(?:^#{1,3}\s|\z)", 1)
    short = F.when(F.length(F.regexp_replace(body, r"^\s+|\s+$", "")) < least, "short Product")
    none = F.when(~brief().rlike(r"(?im)^#{1,3}\s*Art direction\b"), "no Art direction")
    return X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array_compact(F.array(short, none))).alias("problem"))


@query("truncate_context", "SELECT doc_id AS id, length(text) > 6000 AS cut, md5(CASE WHEN length(text) > 6000 THEN substr(text, 1, 6000) || chr(10) || '[truncated]' ELSE text END) AS md5 FROM documents")
def truncate_context(spark, sf, limit: int = 6000):
    """Context past the limit is cut with a mark (the limit is what the operator is for)."""
    long = F.length("text") > limit
    out = F.when(long, F.concat(F.substring("text", 1, limit), F.lit("\n[truncated]"))).otherwise(F.col("text"))
    return X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), long.alias("cut"), F.md5(out.cast("binary")).alias("md5"))


@query("tag_scan", "WITH t AS (SELECT page_id AS id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages) SELECT id, unnest(range(0, len(l))) AS pos, unnest(l) AS href FROM t")
def tag_scan(spark, sf):
    d = X.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return d.select("id", F.col("pos").cast("long").alias("pos"), "href")


# A picture of two paths from an embedding's id.
_SVG = "'<svg><path id=\"a' || vec_id || '\" d=\"M' || vec_id % 9 || ' 0 L 10 ' || vec_id % 7 || ' Z M 1 1 L 2 2 Z\" fill=\"#' || lpad(printf('%x', (vec_id * 7919) % 16777216), 6, '0') || '\"/><path d=\"M 0 0 L 5 5\" style=\"fill: var(--ink, #123456)\"/></svg>'"


def _svg():
    v = F.col("vec_id")
    h = F.lpad(F.lower(F.hex(v * 7919 % 16777216)), 6, "0")
    return F.concat(F.lit('<svg><path id="a'), v, F.lit('" d="M'), v % 9, F.lit(" 0 L 10 "), v % 7, F.lit(' Z M 1 1 L 2 2 Z" fill="#'), h, F.lit('"/><path d="M 0 0 L 5 5" style="fill: var(--ink, #123456)"/></svg>'))


@query("svg_paths", f"WITH t AS (SELECT vec_id AS image_id, regexp_extract_all({_SVG}, '<path[^>]*>') AS l FROM embeddings), u AS (SELECT image_id, unnest(l) AS tag, unnest(range(0, len(l))) AS pos FROM t) SELECT image_id, pos, coalesce(nullif(regexp_extract(tag, ' id=\"([^\"]*)\"', 1), ''), 'path' || pos) AS id, regexp_extract(tag, ' d=\"([^\"]*)\"', 1) AS d, coalesce(nullif(regexp_extract(tag, ' fill=\"([^\"]*)\"', 1), ''), regexp_extract(tag, 'fill:\\s*var\\([^,]*,\\s*(#[0-9a-f]+)\\)', 1)) AS fill FROM u")
def svg_paths(spark, sf):
    """Paths in order, with the fill from the attribute or a style's fallback."""
    d = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode(F.regexp_extract_all(_svg(), F.lit("<path[^>]*>"), F.lit(0))).alias("p", "tag"))
    get = lambda r: F.nullif(F.regexp_extract("tag", r, 1), F.lit(""))
    pos = F.col("p").cast("long")
    return d.select("image_id", pos.alias("pos"), F.coalesce(get(' id="([^"]*)"'), F.concat(F.lit("path"), pos)).alias("id"), F.regexp_extract("tag", ' d="([^"]*)"', 1).alias("d"), F.coalesce(get(' fill="([^"]*)"'), F.regexp_extract("tag", r"fill:\s*var\([^,]*,\s*(#[0-9a-f]+)\)", 1)).alias("fill"))


@query("subpaths", f"WITH t AS (SELECT vec_id AS image_id, regexp_extract_all(regexp_extract({_SVG}, ' d=\"([^\"]*)\"', 1), 'M[^M]*') AS l FROM embeddings) SELECT image_id, unnest(range(0, len(l))) AS pos, unnest(list_transform(l, lambda x: trim(x))) AS d FROM t")
def subpaths(spark, sf):
    parts = F.regexp_extract_all(F.regexp_extract(_svg(), ' d="([^"]*)"', 1), F.lit("M[^M]*"), F.lit(0))
    d = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode(F.transform(parts, lambda x: F.trim(x))).alias("p", "d"))
    return d.select("image_id", F.col("p").cast("long").alias("pos"), "d")


@query("candidate_ids", "WITH c AS (SELECT conv_id || CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN 'e' || turn ELSE 'x' END AS t FROM conversations) SELECT DISTINCT t, CASE WHEN regexp_matches(t, '^\\d+(e\\d+)?$') THEN CAST(regexp_extract(t, '^(\\d+)', 1) AS BIGINT) END AS root, CASE WHEN regexp_matches(t, '^\\d+(e\\d+)?$') THEN coalesce(CAST(nullif(regexp_extract(t, 'e(\\d+)$', 1), '') AS BIGINT), 0) END AS edit FROM c")
def candidate_ids(spark, sf):
    """Text such as 2 or 2e1, never read as a number."""
    n = F.col("turn") % 3
    t = F.concat(F.col("conv_id").cast("string"), F.when(n == 0, "").when(n == 1, F.concat(F.lit("e"), F.col("turn").cast("string"))).otherwise("x"))
    d = X.table(spark, sf, "conversations").select(t.alias("t")).distinct()
    ok = F.col("t").rlike(r"^\d+(e\d+)?$")
    edit = F.coalesce(F.nullif(F.regexp_extract("t", r"e(\d+)$", 1), F.lit("")).cast("long"), F.lit(0))
    return d.select("t", F.when(ok, F.nullif(F.regexp_extract("t", r"^(\d+)", 1), F.lit("")).cast("long")).alias("root"), F.when(ok, edit).alias("edit"))


_ACTS = "p_name || ':' || p_size || ': leap, then: land ;; ' || p_brand || ':' || (p_partkey % 9)"


@query("parse_actions", f"WITH e AS (SELECT p_partkey AS id, list_filter(list_transform(string_split({_ACTS}, ';'), lambda x: trim(x)), lambda x: x <> '') AS l FROM part), u AS (SELECT id, unnest(range(0, len(l))) AS pos, unnest(l) AS x FROM e) SELECT id, pos, trim(string_split(x, ':')[1]) AS name, CAST(trim(string_split(x, ':')[2]) AS BIGINT) AS frames, nullif(trim(regexp_replace(x, '^[^:]*:[^:]*:?', '')), '') AS motion FROM u")
def parse_actions(spark, sf):
    """name:frames[:motion];... where a motion may hold colons and commas."""
    text = F.concat("p_name", F.lit(":"), F.col("p_size").cast("string"), F.lit(": leap, then: land ;; "), "p_brand", F.lit(":"), (F.col("p_partkey") % 9).cast("string"))
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    d = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.posexplode(parts).alias("p", "x"))
    bits = F.split("x", ":")
    return d.select("id", F.col("p").cast("long").alias("pos"), F.trim(bits[0]).alias("name"), F.trim(bits[1]).cast("long").alias("frames"), F.nullif(F.trim(F.regexp_replace("x", "^[^:]*:[^:]*:?", "")), F.lit("")).alias("motion"))


_VAR = "'wght=' || (p_partkey % 900) || ',wd:' || p_size || '; GRAD = ' || (p_partkey % 50)"


@query("parse_variation", f"WITH l AS (SELECT p_partkey AS id, regexp_extract_all({_VAR}, '([A-Za-z]+)\\s*[=:]\\s*([0-9.]+)', 0) AS l FROM part), u AS (SELECT id, unnest(l) AS x FROM l) SELECT id, rpad(regexp_extract(x, '^([A-Za-z]+)', 1), 4, ' ') AS tag, CAST(regexp_extract(x, '([0-9.]+)$', 1) AS DOUBLE) AS value FROM u")
def parse_variation(spark, sf):
    text = F.concat(F.lit("wght="), (F.col("p_partkey") % 900).cast("string"), F.lit(",wd:"), F.col("p_size").cast("string"), F.lit("; GRAD = "), (F.col("p_partkey") % 50).cast("string"))
    d = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(r"([A-Za-z]+)\s*[=:]\s*([0-9.]+)"), F.lit(0))).alias("x"))
    return d.select("id", F.rpad(F.regexp_extract("x", "^([A-Za-z]+)", 1), 4, " ").alias("tag"), F.regexp_extract("x", "([0-9.]+)$", 1).cast("double").alias("value"))


@query("file_base", "SELECT DISTINCT conv_id AS root, turn AS edit, lpad(CAST(conv_id AS VARCHAR), CAST(greatest(2, length(CAST(conv_id AS VARCHAR))) AS INTEGER), '0') || CASE WHEN turn > 0 THEN 'e' || turn ELSE '' END AS base FROM conversations")
def file_base(spark, sf):
    n = F.col("conv_id").cast("string")
    pad = F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)
    return X.table(spark, sf, "conversations").select(F.col("conv_id").alias("root"), F.col("turn").alias("edit"), F.concat(pad, F.when(F.col("turn") > 0, F.concat(F.lit("e"), F.col("turn").cast("string"))).otherwise("")).alias("base")).distinct()


@query("mime_of", "SELECT conv_id AS id, turn, kind AS mime FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' END AS kind FROM conversations) q")
def mime_of_query(spark, sf):
    """Magic bytes, never the name; what is shorter than 12 bytes is nothing."""
    head = F.when(F.col("turn") % 4 == 0, F.unhex(F.lit("89504E470D0A1A0A0000000D"))).when(F.col("turn") % 4 == 1, F.unhex(F.lit("FFD8FFE000104A4649460001"))).when(F.col("turn") % 4 == 2, F.unhex(F.lit("524946460000000057454250"))).otherwise(F.unhex(F.lit("474946383961")))
    return X.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", mime_of(head).alias("mime"))


def mime_of(content: Column) -> Column:
    at = lambda i, n: F.hex(F.substring(content, i, n))
    known = (
        F.when(at(1, 4) == "89504E47", "image/png").when(at(1, 3) == "FFD8FF", "image/jpeg")
        .when((at(1, 4) == "52494646") & (at(9, 4) == "57454250"), "image/webp").when(at(1, 4) == "47494638", "image/gif")
    )
    return F.when(F.octet_length(content) >= 12, known)


@query("atlas_names", f"WITH {X.FRAMES} SELECT image_id, 'act' || action || '_' || frame_ix AS name, to_json({{'x': frame_ix * 4, 'y': action * 4, 'w': 4, 'h': 4}}) AS frame FROM frm")
def atlas_names(spark, sf):
    f = X.frames(spark, sf)
    rect = F.struct((F.col("frame_ix") * 4).alias("x"), (F.col("action") * 4).alias("y"), F.lit(4).alias("w"), F.lit(4).alias("h"))
    return f.select("image_id", F.concat(F.lit("act"), F.col("action"), F.lit("_"), F.col("frame_ix")).alias("name"), F.to_json(rect).alias("frame"))


@query("css_keyframes", f"WITH {X.FRAMES}, a AS (SELECT action, count(*) AS n FROM frm GROUP BY action) SELECT action, '.act' || action || '{{animation:act' || action || ' ' || CAST(n * 125 AS VARCHAR) || 'ms steps(' || n || ') infinite}}' AS css FROM a")
def css_keyframes(spark, sf):
    a = X.packed(spark, sf).groupBy("action").agg(F.count("*").alias("n"))
    return a.select("action", F.concat(F.lit(".act"), "action", F.lit("{animation:act"), "action", F.lit(" "), (F.col("n") * 125), F.lit("ms steps("), "n", F.lit(") infinite}")).alias("css"))


@query("packed_vector", "SELECT vec_id AS image_id, 'PackedVector2Array(' || vec_id % 9 || ', 0, ' || CAST(floor(vec_id / 7.0 * 100 + 0.5) / 100 AS DECIMAL(12, 2)) || ', -' || vec_id % 5 + 1 || ')' AS text FROM embeddings")
def packed_vector(spark, sf):
    v = F.col("vec_id")
    return X.table(spark, sf, "embeddings").select(v.alias("image_id"), F.concat(F.lit("PackedVector2Array("), v % 9, F.lit(", 0, "), half_up(v / 7.0, 2).cast("decimal(12,2)"), F.lit(", -"), v % 5 + 1, F.lit(")")).alias("text"))


@query("fnt_lines", "SELECT p_partkey AS id, 'char' AS kind, p_partkey % 128 AS char_id, CAST(p_size AS BIGINT) AS xadvance, p_name AS letter FROM part")
def fnt_lines(spark, sf):
    """A line of a bitmap font's text written and read back: its kind, numbers and quoted strings."""
    line = F.format_string('char id=%d xadvance=%d letter="%s"', F.col("p_partkey") % 128, F.col("p_size"), F.col("p_name"))
    d = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), line.alias("l"))
    num = lambda k: F.regexp_extract("l", rf"\b{k}=(-?\d+)", 1).cast("long")
    return d.select("id", F.regexp_extract("l", r"^(\w+)", 1).alias("kind"), num("id").alias("char_id"), num("xadvance").alias("xadvance"), F.regexp_extract("l", r'letter="([^"]*)"', 1).alias("letter"))


@query("edits_in_order", "SELECT conv_id AS root, string_agg(role, '>' ORDER BY turn) AS chain, count(*) AS edits FROM conversations GROUP BY conv_id")
def edits_in_order(spark, sf):
    """The roles of a chain in order; chains are as long as their edits, a few."""
    c = X.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"), F.count("*").alias("edits"))
    return c.select(F.col("conv_id").alias("root"), F.array_join(F.transform("l", lambda e: e["role"]), ">").alias("chain"), "edits")
