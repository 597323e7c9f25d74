"""Queries on text ETL and chunking (T*, C*, K5, S5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import text as x, vocabulary as voc
from riskloom.plans.base import query
from riskloom.sources.connectors import clean_country_name
from riskloom.sources.fixtures import table

WORDS = ["the", "licensed", "que", "der ", "est", "idiot", "and there"]
STRONG = ["licensed", "idiot"]
#: Invented prose with phrases of earnings calls behind it.
_CALLS = (
    " Our conference call replay is here.", " We depend on a single source. Supply constraints and delayed shipments hurt us after the factory shutdown this year.",
    " Parts procured from many vendors and supplied by others are short, and shortages persist in every plant.", " Delays of many kinds without any other word about it at all.",
)
_CALL_SQL = "text || CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CALLS)) + " ELSE '' END"
_W = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
_S = "[" + ", ".join(f"'{w}'" for w in STRONG) + "]"
_TRIM = r"' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_NORM = rf"trim(regexp_replace(regexp_replace(replace(replace(replace(text, chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g'), {_TRIM})"
_COUNT = r"len(list_filter(regexp_split_to_array({c}, '[ \t\n\r\f\x0b]+'), lambda w: w <> ''))"
_SENT = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {_TRIM})), lambda s: s <> '')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _call(c: str = "text"):
    tail = F.create_map(*[F.lit(v) for i, t in enumerate(_CALLS) for v in (i, t)])
    return F.concat(c, F.coalesce(F.try_element_at(tail, (F.col("doc_id") % 8).cast("int")), F.lit("")))


def _duck(pattern: str) -> str:
    """The same pattern with Unicode word borders for an engine whose borders are ASCII."""
    return "(?i)" + pattern.replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])")


def _any(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{_duck(p)}')" for p in patterns) + ")"


def _labels(c: str) -> str:
    """SQL list of a sentence's labels."""
    found = lambda table: "[" + ", ".join(f"CASE WHEN regexp_matches({c}, '{_duck(p)}') THEN '{n}' END" for n, p in table) + "]"
    about = " OR ".join(f"contains(lower({c}), '{w}')" for w in voc.SUPPLY_CONTEXT)
    return f"list_sort(list_distinct(list_filter(list_concat({found(voc.DEPENDENCY_LABELS)}, CASE WHEN {about} THEN {found(voc.DISRUPTION_LABELS)} ELSE [] END), lambda v: v IS NOT NULL)))"


@query("normalize_text", rf"SELECT doc_id, md5({_NORM}) AS digest, length({_NORM}) AS n FROM documents")
def normalize_text(spark, sf_dir):
    """T1."""
    n = x.normalize_text(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(n.cast("binary")).alias("digest"), F.length(n).cast("long").alias("n"))


@query("min_words", f"SELECT doc_id, {_COUNT.format(c='text')} AS words FROM documents WHERE {_COUNT.format(c='text')} >= 80")
def min_words(spark, sf_dir):
    """T7."""
    return _docs(spark, sf_dir).select("doc_id", x.word_count(F.col("text")).alias("words")).where("words >= 80")


@query("keyword_hits", f"SELECT doc_id, array_to_string(list_filter({_W}, lambda w: contains(lower(text), w)), '|') AS hits FROM documents")
def keyword_hits(spark, sf_dir):
    """T3."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(x.keyword_hits(F.col("text"), WORDS), "|").alias("hits"))


@query("boilerplate", f"SELECT doc_id FROM (SELECT doc_id, {_CALL_SQL} AS t FROM documents) WHERE {_any('t', voc.BOILERPLATE)}")
def boilerplate(spark, sf_dir):
    """T4."""
    return _docs(spark, sf_dir).where(x.any_of(_call(), voc.BOILERPLATE)).select("doc_id")


@query("relevant_docs", f"SELECT doc_id FROM documents WHERE len(list_filter({_S}, lambda w: contains(lower(text), w))) > 0 OR len(list_filter({_W}, lambda w: contains(lower(text), w))) >= 2")
def relevant_docs(spark, sf_dir):
    """T5."""
    return _docs(spark, sf_dir).where(x.is_relevant(F.col("text"), WORDS, STRONG)).select("doc_id")


@query("relevant_lines", rf"SELECT doc_id, count(*) AS n, sum(length(b)) AS chars FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split({_NORM}, chr(10)), lambda l: trim(l, {_TRIM})), lambda l: l <> '')) AS b FROM documents) WHERE len(list_filter({_S}, lambda w: contains(lower(b), w))) > 0 OR len(list_filter({_W}, lambda w: contains(lower(b), w))) >= 2 GROUP BY doc_id")
def relevant_lines(spark, sf_dir):
    """Relevant blocks (lines here) kept."""
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split(x.normalize_text(F.col("text")), "\n")).alias("b"))
    b = F.btrim(F.col("b"), F.lit(x.WS))
    kept = lines.withColumn("b", b).where("b <> ''").where(x.is_relevant(F.col("b"), WORDS, STRONG))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("b")).alias("chars"))


@query("split_blocks")
def split_blocks(spark, sf_dir):
    """Needs lookahead, which the oracle's regex engine lacks."""
    blocks = x.split_blocks(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(blocks).cast("long").alias("blocks"), F.md5(F.array_join(blocks, "\x01").cast("binary")).alias("digest"))


@query("turns")
def turns(spark, sf_dir):
    """Turns of labelled texts; rows only, for the same reason."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.initcap("role"), F.lit(": "), "text").alias("s")))).alias("r"))
    text = F.array_join(F.transform("r", lambda e: e["s"]), "\n")
    label = F.lower(F.col("t.label"))
    drop = label.isin("operator", "analysts", "participants") | F.contains(label, F.lit("system"))
    return t.select("conv_id", F.explode(x.turns(text)).alias("t")).where(~drop).select("conv_id", "t.label", F.length("t.content").alias("chars"))


_HEADED = "'Company: Co ' || doc_id || chr(10) || ' cik: 7 ' || chr(10) || '[Earnings Call | 2020 | Q1]' || chr(10) || text"
_LINES = f"list_transform(regexp_split_to_array({_HEADED}, '\\r\\n|[\\n\\r]'), lambda l: trim(l, {_TRIM}))"


@query("strip_header_lines", f"SELECT doc_id, md5(array_to_string(list_filter({_LINES}, lambda l: l <> '' AND NOT {_any('l', voc.HEADER_LINES)}), chr(10))) AS digest FROM documents")
def strip_header_lines(spark, sf_dir):
    """T9."""
    text = F.concat(F.lit("Company: Co "), F.col("doc_id").cast("string"), F.lit("\n cik: 7 \n[Earnings Call | 2020 | Q1]\n"), "text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(x.strip_header_lines(text).cast("binary")).alias("digest"))


_LABEL = "CASE turn % 4 WHEN 0 THEN 'Operator 1' WHEN 1 THEN ' Analyst A ' WHEN 2 THEN 'Executives' ELSE 'Jane Doe' END"
_SAID = "text || CASE conv_id % 5 WHEN 0 THEN ' see the press release' ELSE '' END"


@query("dropped_turns", f"SELECT conv_id, turn, l IN ({', '.join(map(repr, voc.DROPPED_LABELS))}) OR contains(l, 'operator') OR (contains(l, 'analyst') AND {_COUNT.format(c='c')} < 20) OR {_any('c', voc.DROPPED_CONTENT)} AS dropped FROM (SELECT conv_id, turn, lower(trim({_LABEL})) AS l, {_SAID} AS c FROM conversations)")
def dropped_turns(spark, sf_dir):
    """T12."""
    t = table(spark, sf_dir, "conversations")
    n = F.col("turn") % 4
    label = F.when(n == 0, "Operator 1").when(n == 1, " Analyst A ").when(n == 2, "Executives").otherwise("Jane Doe")
    said = F.concat("text", F.when(F.col("conv_id") % 5 == 0, " see the press release").otherwise(""))
    return t.select("conv_id", "turn", x.drop_turn(label, said).alias("dropped"))


@query("sentences", f"SELECT doc_id, len({_SENT}) AS n, md5(array_to_string({_SENT}, chr(1))) AS digest FROM documents")
def sentences(spark, sf_dir):
    """T15."""
    s = x.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\x01").cast("binary")).alias("digest"))


@query("split_speaker", "SELECT item_id, CASE WHEN contains(t, ':') THEN trim(substr(t, 1, instr(t, ':') - 1)) ELSE '' END AS speaker, length(CASE WHEN contains(t, ':') THEN trim(substr(t, instr(t, ':') + 1)) ELSE trim(t) END) AS chars FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Speaker ' || item_id || ' : ' || text ELSE text END AS t FROM benchmark)")
def split_speaker(spark, sf_dir):
    """Speaker and body at the first colon."""
    t = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Speaker "), "item_id", F.lit(" : "), "text")).otherwise(F.col("text"))
    parts = table(spark, sf_dir, "benchmark").select("item_id", x.split_speaker(t).alias("p"))
    return parts.select("item_id", "p.speaker", F.length("p.body").cast("long").alias("chars"))


_CALL_SENT = _SENT.replace("regexp_replace(text,", f"regexp_replace({_CALL_SQL},")


@query("sentence_hits", f"SELECT doc_id, pos, array_to_string({_labels('s')}, ',') AS labels FROM (SELECT doc_id, unnest(range(len({_CALL_SENT}))) AS pos, unnest({_CALL_SENT}) AS s FROM documents)")
def sentence_hits(spark, sf_dir):
    """Sorted labels of each sentence."""
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(x.sentences(_call())).alias("pos", "s"))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join(x.sentence_labels(F.col("s")), ",").alias("labels"))


@query("filter_turns", f"""SELECT doc_id, string_agg(s, ' ' ORDER BY pos) AS kept_body, array_to_string(list_sort(list_distinct(flatten(list(l)))), ',') AS labels
FROM (SELECT doc_id, pos, s, {_labels('s')} AS l FROM (SELECT doc_id, unnest(range(len({_CALL_SENT}))) AS pos, unnest({_CALL_SENT}) AS s FROM documents WHERE NOT contains(text, ':'))) WHERE len(l) > 0 AND {_COUNT.format(c='s')} >= 8 GROUP BY doc_id""".replace("string_agg(s, ' ' ORDER BY pos) AS kept_body", "'Speaker ' || doc_id || ': ' || string_agg(s, ' ' ORDER BY pos) AS kept"))
def filter_turns(spark, sf_dir):
    """The labelled sentences of a turn with its speaker, and the union of their labels."""
    turn = F.concat(F.lit("Speaker "), F.col("doc_id").cast("string"), F.lit(": "), _call())
    rows = _docs(spark, sf_dir).where(~F.contains("text", F.lit(":"))).select("doc_id", x.filter_turn(turn).alias("t")).where("t.text is not null")
    return rows.select("doc_id", F.col("t.text").alias("kept"), F.array_join("t.labels", ",").alias("labels"))


@query("neighbor_keep", "SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN length(text) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM conversations) WHERE near = 1")
def neighbor_keep(spark, sf_dir):
    """Matched turns and their neighbours."""
    return x.keep_neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") > 400, 1).select("conv_id", "turn")


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"""
for _c, _r in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#8217;", "''"), ("&#8220;", '"'), ("&#8221;", '"')):
    _HTML = f"replace({_HTML}, '{_c}', '{_r}')"
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_HTML = rf"trim(regexp_replace(regexp_replace(regexp_replace({_HTML}, '&#[0-9]+;', ' ', 'g'), '&[\p{{L}}\p{{M}}\p{{N}}_]+;', ' ', 'g'), '{_BLANK}', ' ', 'g'), {_TRIM})"


@query("strip_html", f"SELECT page_id, length({_HTML}) AS chars, md5({_HTML}) AS digest FROM pages")
def strip_html(spark, sf_dir):
    """T19."""
    t = x.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.md5(t.cast("binary")).alias("digest"))


@query("char_chunks", rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'), {_TRIM}) AS t FROM documents),
w AS (SELECT doc_id, i, t, length(t) AS n, substr(t, i * 2100 + 1, 2400) AS s FROM t, LATERAL (SELECT unnest(range(greatest(CAST(ceil((length(t) - 2400) / 2100.0) AS BIGINT), 0) + 1)) AS i) WHERE length(t) > 0)
SELECT doc_id, i + 1 AS chunk, md5(trim(CASE WHEN i * 2100 + 2400 < n AND instr(reverse(s), ' .') > 0 AND length(s) - instr(reverse(s), ' .') - 1 > 400 THEN substr(s, 1, length(s) - instr(reverse(s), ' .')) ELSE s END, {_TRIM})) AS digest FROM w""")
def char_chunks(spark, sf_dir):
    """Character windows with overlap."""
    return x.char_chunks(_docs(spark, sf_dir), "doc_id", F.col("text")).select("doc_id", "chunk", F.md5(F.col("piece").cast("binary")).alias("digest"))


@query("sentence_chunks")
def sentence_chunks(spark, sf_dir):
    """A state machine per document; checked in tests."""
    return x.sentence_chunks(_docs(spark, sf_dir), "doc_id", F.col("text"))


_SNIP = ["licensed", "apache", "idiot"]


@query("snippets", f"""WITH RECURSIVE w AS (SELECT doc_id, text AS t, lower(text) AS low, unnest({_SNIP}) AS word FROM documents),
hit(doc_id, t, low, word, place) AS (SELECT doc_id, t, low, word, instr(low, word) - 1 FROM w WHERE contains(low, word)
UNION ALL SELECT doc_id, t, low, word, place + length(word) + instr(substr(low, place + length(word) + 1), word) - 1 FROM hit WHERE contains(substr(low, place + length(word) + 1), word))
SELECT doc_id, word, CAST(place AS INTEGER) AS place, substr(substr(t, greatest(0, place - 250) + 1, place + length(word) + 250 - greatest(0, place - 250)), 1, 300) AS evidence FROM hit""")
def snippets(spark, sf_dir):
    """Every occurrence of each keyword in context."""
    return x.snippets(_docs(spark, sf_dir), "doc_id", F.col("text"), _SNIP)


_LOW = "lower(n)"
_LETTERS = "length(regexp_replace(n, '[^\\p{L}]', '', 'g'))::DOUBLE / greatest(length(n), 1)"
_NAMED = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'Exhibit ' || p_name WHEN 2 THEN 'Face ID' WHEN 3 THEN '3M ' || p_name WHEN 4 THEN 'Part Part' ELSE 'Big Bolt Works' END"
_FILING = f"""length(n) BETWEEN 4 AND 80 AND NOT regexp_matches(n, '^[0-9]') AND NOT contains(n, '/') AND len(string_split(n, ' ')) - 1 <= 7 AND {_LOW} NOT IN ({", ".join(map(repr, voc.FILING_SKIPPED))})
  AND NOT regexp_matches(n, '(?i){voc.FILING_LEGAL}') AND NOT contains({_LOW}, 'bolt works') AND NOT contains('bolt works', {_LOW}) AND {_LETTERS} >= 0.55 AND len(string_split(n, ' ')) = len(list_distinct(string_split(n, ' ')))"""


@query("entity_name_ok", f"""SELECT p_partkey, {_FILING} AS filing, length(n) >= 3 AND NOT regexp_matches(n, '^[0-9]') AND {_LOW} NOT IN ({", ".join(map(repr, voc.COMPONENT_SKIPPED))}) AND {_LETTERS} >= 0.5 AS maker FROM (SELECT p_partkey, {_NAMED} AS n FROM part)""")
def entity_name_ok(spark, sf_dir):
    """Plausibility of names found in filings and in teardowns."""
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    name = F.when(k == 0, n).when(k == 1, F.concat(F.lit("Exhibit "), n)).when(k == 2, "Face ID").when(k == 3, F.concat(F.lit("3M "), n)).when(k == 4, "Part Part").otherwise("Big Bolt Works")
    parts = table(spark, sf_dir, "part").select("p_partkey", name.alias("n"))
    return parts.select("p_partkey", x.filing_entity_ok(F.col("n"), F.lit("Bolt Works")).alias("filing"), x.component_maker_ok(F.col("n")).alias("maker"))


_KEYED = "CASE p_partkey % 5 WHEN 0 THEN 'Our Contract Manufacturer' WHEN 1 THEN 'a sole source part' WHEN 2 THEN 'assembly and supply' WHEN 3 THEN 'procured' ELSE p_type END"


@query("keyword_relation", f"SELECT p_partkey, CASE {' '.join(f'WHEN contains(t, {k!r}) THEN {r!r}' for k, r in voc.KEYWORD_RELATIONS)} ELSE 'SUPPLIES' END AS relation FROM (SELECT p_partkey, lower({_KEYED}) AS t FROM part)")
def keyword_relation(spark, sf_dir):
    """The first keyword decides the relation."""
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, "Our Contract Manufacturer").when(k == 1, "a sole source part").when(k == 2, "assembly and supply").when(k == 3, "procured").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", x.keyword_relation(t).alias("relation"))


@query("clean_country", r"SELECT n_nationkey, trim(regexp_replace(trim(regexp_replace(trim(replace(n_name || CASE n_nationkey % 3 WHEN 0 THEN '12, 3' WHEN 1 THEN 'Ne' ELSE chr(160) END, chr(160), ' ')), '[0-9,]+$', '')), '([^aeiouAEIOU ])e$', '\1')) AS name FROM nation")
def clean_country(spark, sf_dir):
    """Trailing footnote marks of country names."""
    tail = F.when(F.col("n_nationkey") % 3 == 0, "12, 3").when(F.col("n_nationkey") % 3 == 1, "Ne").otherwise("\u00a0")
    return table(spark, sf_dir, "nation").select("n_nationkey", clean_country_name(F.concat("n_name", tail)).alias("name"))


@query("null_tokens", "SELECT l_returnflag, count(CASE WHEN l_linestatus IN ('O', '', '-', 'W', 'NA') THEN NULL ELSE 1 END) AS n FROM lineitem GROUP BY l_returnflag")
def null_tokens(spark, sf_dir):
    """Marks that stand for a missing value."""
    known = F.when(F.col("l_linestatus").isin("O", "", "-", "W", "NA"), F.lit(None)).otherwise(1)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(known).alias("n"))


@query("norm_keys", r"SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(strip_accents(s_name || ', Ç.A.')), '[^a-z0-9_ \t\n]', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM supplier")
def norm_keys(spark, sf_dir):
    """Unaccented lower-case key."""
    from riskloom.operators.resolve import unaccented_key

    return table(spark, sf_dir, "supplier").select("s_suppkey", unaccented_key(F.concat("s_name", F.lit(", Ç.A."))).alias("k"))


@query("legal_suffix", r"SELECT c_custkey, lower(trim(regexp_replace(regexp_replace(c_name || CASE c_custkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN '  Corp' ELSE '' END, '(?i)\s+(inc\.?|corp\.?|co\.?|ltd\.?|llc\.?|l\.p\.?|plc\.?|n\.v\.?|ag\.?|gmbh\.?|s\.a\.?|holdings?|group|limited|incorporated|corporation|company)\.?$', ''), '\s+', ' ', 'g'))) AS k FROM customer")
def legal_suffix(spark, sf_dir):
    """One trailing legal suffix goes."""
    from riskloom.operators.resolve import company_key

    suffix = F.when(F.col("c_custkey") % 4 == 0, " Inc.").when(F.col("c_custkey") % 4 == 1, " LLC").when(F.col("c_custkey") % 4 == 2, "  Corp").otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", company_key(F.concat("c_name", suffix)).alias("k"))


@query("company_merge", f"""SELECT source, lang, count(*) AS docs, min(text) FILTER (doc_id = m) AS first_text_, array_to_string(list_sort(list_distinct(flatten(list(list_filter({_W}, lambda w: contains(lower(text), w)))))), '|') AS words
FROM (SELECT *, min(doc_id) OVER (PARTITION BY source, lang) AS m FROM documents) GROUP BY source, lang""".replace("min(text) FILTER (doc_id = m) AS first_text_", "md5(min(text) FILTER (doc_id = m)) AS first_text"))
def company_merge(spark, sf_dir):
    """Grouped records with the first text and the union of keywords."""
    d = _docs(spark, sf_dir).withColumn("h", x.keyword_hits(F.col("text"), WORDS))
    words = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("h")))), "|")
    return d.groupBy("source", "lang").agg(F.count("*").alias("docs"), F.md5(F.min_by("text", "doc_id").cast("binary")).alias("first_text"), words.alias("words"))


@query("text_export", "SELECT doc_id, '### ' || source || ' (' || lang || ')' AS head FROM documents ORDER BY doc_id LIMIT 25")
def text_export(spark, sf_dir):
    """K5: readable export of the first records (a report)."""
    return _docs(spark, sf_dir).orderBy("doc_id").limit(25).select("doc_id", F.concat(F.lit("### "), "source", F.lit(" ("), "lang", F.lit(")")).alias("head"))
