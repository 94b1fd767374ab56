"""Queries over names, answers, records and row contracts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import answers, ids, records, web
from riskloom.operators import contracts, evals, verdicts
from riskloom.plans.catalog import pick, pick_sql, query, read

# ---------------------------------------------------------------- names and identities

PATH_SQL = r"""
    u AS (SELECT page_id, url, regexp_extract(url, '(?i)^(https?)://([^/?#]+)([^?#]*)', 3) AS path FROM pages),
    n AS (SELECT *, regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) AS name, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS raw FROM u),
    s AS (SELECT *, lower(regexp_extract(name, '[^.](\.[^.]+)$', 1)) AS suffix, regexp_replace(name, '([^.])\.[^.]+$', '\1') AS stem,
                 lower(regexp_extract(raw, '[^.](\.[^.]+)$', 1)) AS raw_suffix, regexp_replace(raw, '([^.])\.[^.]+$', '\1') AS raw_stem FROM n)"""
MIMES = ["text/html", "application/pdf", "text/plain; charset=utf-8", "image/png"]


@query(rf"""
    WITH {PATH_SQL} SELECT page_id, nullif(trim(translate(stem, '_-', '  ')), '') AS title, CASE substr(suffix, 2) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ids.MIME_TYPES.items())} END AS mime_type,
        CASE WHEN suffix = '.htm' THEN '.html' WHEN suffix IN ({", ".join(f"'{x}'" for x in web.SUPPORTED)}) THEN suffix ELSE CASE page_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE '.bin' END END AS extension,
        substr(coalesce(nullif(regexp_replace(regexp_replace(raw_stem, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'file'), 1, 90) || substr(regexp_replace(raw_suffix, '[^A-Za-z0-9.]', '', 'g'), 1, 16) AS filename,
        regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS id_part, regexp_matches(trim(url), '^[A-Za-z0-9][A-Za-z0-9_.-]*$') AS is_id FROM s""")
def source_names(spark, sf_dir):
    """What the engine calls a source: title, media type, extension, file name, id part."""
    url = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", ids.filename_title(url).alias("title"), ids.mime_type(url).alias("mime_type"), ids.extension_for(pick("page_id", MIMES), url).alias("extension"),
        ids.safe_filename(url).alias("filename"), ids.id_part(url).alias("id_part"), ids.is_id_part(url).alias("is_id"),
    )


@query(r"""
    SELECT p_partkey, regexp_replace(regexp_replace(p_name || '/' || p_brand || '..', '[^\p{L}\p{N}_.-]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS safe_name, p_partkey % 5 <> 0 AS named FROM part""")
def safe_names(spark, sf_dir):
    name = ids.safe_name(F.concat("p_name", F.lit("/"), "p_brand", F.lit("..")))
    empty = ids.safe_name(F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")), "unnamed") != "unnamed"
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("safe_name"), empty.alias("named"))


@query(r"""
    WITH s AS (SELECT page_id, url, 'src_' || substr(sha256('"' || url || '"'), 1, 16) AS source_id FROM pages)
    SELECT page_id, source_id, 'doc_' || substr(sha256('"' || source_id || '"'), 1, 16) AS document_id, 'art_' || substr(sha256('["' || url || '", "' || page_id || '"]'), 1, 16) AS artifact_id,
        CASE WHEN page_id % 3 = 0 THEN 'src_' || substr(sha256('{"canonical_source": "' || url || '", "local_path": null, "source": "' || url || '"}'), 1, 20) ELSE 'given' || page_id END AS row_id,
        'entity_merge_decision_' || substr(sha256('{"entity_id": "' || page_id || '", "incoming_key": "k", "name": "n", "source_url": "' || url || '", "type": null}'), 1, 20) AS decision_id,
        CASE WHEN page_id % 3 = 0 THEN 'url' WHEN page_id % 3 = 1 THEN 'file_sha256' ELSE 'unresolved_path' END AS fingerprint_type FROM s""")
def stable_ids(spark, sf_dir):
    url, k, none = F.col("url"), F.col("page_id"), F.lit(None).cast("string")
    source = ids.source_id(url)
    row = ids.row_source_id(F.when(k % 3 != 0, F.concat(F.lit("given"), k)), url, url, none)
    print_ = ids.fingerprint(F.when(k % 3 == 0, url).otherwise(F.concat(F.lit("/data/"), k)), F.when(k % 3 == 1, F.lit("abc")), F.lit(10), F.lit(1.5))
    return read(spark, sf_dir, "pages").select(
        k, source.alias("source_id"), ids.document_id(source).alias("document_id"), ids.artifact_id(url, k.cast("string")).alias("artifact_id"), row.alias("row_id"),
        ids.merge_decision_id(F.lit("k"), url, k.cast("string"), F.lit("n"), none).alias("decision_id"), print_["fingerprint_type"].alias("fingerprint_type"),
    )


@query(rf"""
    WITH {PATH_SQL}, m AS (SELECT *, page_id % 2 = 0 AS given FROM s)
    SELECT page_id, CASE WHEN given THEN 'T' || page_id ELSE nullif(trim(translate(stem, '_-', '  ')), '') END AS title, CASE WHEN given THEN 'by' ELSE NULL END AS author,
        url AS source_url, lower(regexp_extract(url, '(?i)^(https?)://([^/?#]+)', 2)) AS domain FROM m""")
def base_metadata(spark, sf_dir):
    k, url = F.col("page_id"), F.col("url")
    given = lambda c: F.when(k % 2 == 0, c).otherwise(F.lit(""))
    out = ids.base_metadata(url, {"title": given(F.concat(F.lit("T"), k)), "author": F.lit(""), "byline": given(F.lit("by"))})
    return read(spark, sf_dir, "pages").select(k, *(out[n].alias(n) for n in ("title", "author", "source_url", "domain")))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'iso-8859-1' WHEN 1 THEN 'utf-8' ELSE 'utf-8' END AS charset, html = html AS same FROM pages")
def decoded_pages(spark, sf_dir):
    """Bytes of each page read back by the declared character set; an unknown one counts as UTF-8."""
    k = F.col("page_id")
    kind = F.when(k % 3 == 0, "text/html; charset=iso-8859-1").when(k % 3 == 1, "text/html").otherwise("text/html; Charset=utf-8")
    raw = F.when(k % 3 == 0, F.encode(F.regexp_replace("html", r"[^\x00-\xff]", "?"), "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    back = ids.decoded(raw, kind)
    same = back == F.when(k % 3 == 0, F.regexp_replace("html", r"[^\x00-\xff]", "?")).otherwise(F.col("html"))
    return read(spark, sf_dir, "pages").select(k, ids.charset(kind).alias("charset"), same.alias("same"))


# ---------------------------------------------------------------- answers

ANSWER = """CASE turn % 4 WHEN 0 THEN '**Summary and limitation**: ' || text WHEN 1 THEN 'Based on all of this: ' || text WHEN 2 THEN '- __risk assessment__ - ' || text ELSE '2. **' || text || '**' END"""


def squeeze_sql(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def cut_sql(c: str, most: int) -> str:
    return f"CASE WHEN length({c}) <= {most} THEN {c} ELSE rtrim(substr({c}, 1, {most - 1})) || '…' END"


PLAIN_SQL = squeeze_sql(r"regexp_replace(regexp_replace(regexp_replace(a, '\*\*(.*?)\*\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '^\s*[-*]\s+', '')")


def clean_sql(c: str) -> str:
    for pattern in answers.OPENINGS:
        c = f"regexp_replace({c}, '{pattern}', '')"
    return squeeze_sql(c)


def sentences_sql(c: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(rf"""
    WITH t AS (SELECT conv_id, turn, coalesce({ANSWER}, '') AS a FROM conversations), p AS (SELECT *, {PLAIN_SQL} AS plain FROM t), c AS (SELECT *, {clean_sql('plain')} AS cleaned FROM p),
    f AS (SELECT *, CASE WHEN regexp_matches(plain, '{answers.SUMMARY}') THEN {clean_sql(squeeze_sql(f"regexp_extract(plain, '{answers.SUMMARY}', 1)"))} ELSE cleaned END AS body FROM c),
    g AS (SELECT *, {sentences_sql('body')} AS s, {squeeze_sql('a')} AS flat FROM f), h AS (SELECT *, CASE WHEN len(s) > 0 THEN array_to_string(s[1:2], ' ') ELSE body END AS two FROM g)
    SELECT conv_id, turn, plain, cleaned, CASE WHEN cleaned = '' THEN '' WHEN length(two) <= 520 THEN two ELSE rtrim(substr(two, 1, 517)) || '...' END AS opening,
        CASE WHEN flat = '' THEN 'No text available.' ELSE {cut_sql('flat', 420)} END AS short FROM h""")
def clean_answers(spark, sf_dir):
    a = F.expr(ANSWER)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", answers.strip_markdown(a).alias("plain"), answers.clean_answer(a).alias("cleaned"), answers.first_sentences(a).alias("opening"), answers.short_text(a).alias("short"))


BOLD_SQL = squeeze_sql(r"regexp_replace(a, '\*\*(.*?)\*\*', '\1', 'g')")
STORY = "CASE turn % 3 WHEN 0 THEN 'The current investigation stands. ' WHEN 1 THEN '3. ' ELSE 'Based on the available evidence! ' END || text"


@query(rf"""
    WITH t AS (SELECT conv_id, turn, coalesce({STORY}, '') AS a FROM conversations), f AS (SELECT *, trim(regexp_replace({BOLD_SQL}, '^\d+\.\s+', '')) AS x FROM t),
    g AS (SELECT *, {cut_sql('x', 5000)} AS y FROM f), s AS (SELECT *, {sentences_sql('y')} AS every FROM g),
    k AS (SELECT *, list_filter(every, lambda e: NOT ({" OR ".join(f"starts_with(lower(e), '{b}')" for b in answers.BOILERPLATE)})) AS kept FROM s)
    SELECT conv_id, turn, CASE WHEN len(kept) > 0 THEN len(kept) ELSE len(every) END AS n, CASE WHEN len(kept) > 0 THEN kept[1] ELSE every[1] END AS first FROM k""")
def story_sentences(spark, sf_dir):
    s = answers.story_sentences(F.expr(STORY))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(s).cast("long").alias("n"), F.get(s, F.lit(0)).alias("first"))


SECTIONS = "'**Findings**: ' || text || ' Open points: none'"


@query(rf"""
    WITH t AS (SELECT conv_id, turn, coalesce({SECTIONS}, '') AS a FROM conversations),
    f AS (SELECT conv_id, turn, trim(regexp_replace({squeeze_sql("regexp_replace(regexp_extract(a, '(?is)(?:\\*\\*)?Findings(?:\\*\\*)?\\s*:?\\s*(.*?)(?:(?:\\*\\*)?[A-Z][A-Za-z0-9 /&,\\-]{2,90}(?:\\*\\*)?\\s*:|\\z)', 1), '\\*\\*(.*?)\\*\\*', '\\1', 'g')")}, '^\d+\.\s+', '')) AS x FROM t)
    SELECT conv_id, turn, {cut_sql('x', 900)} AS section FROM f""")
def answer_sections(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", answers.answer_section(F.expr(SECTIONS), "Findings").alias("section"))


@query(r"""
    SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Source' WHEN page_id % 5 = 1 THEN 'Source' WHEN page_id % 5 = 2 THEN 'annual report ' || page_id || '.pdf' WHEN page_id % 5 = 3 THEN 'Plain title' ELSE 'Source' END AS title,
        page_id % 5 IN (1, 4) AS internal, page_id % 4 IN (0, 1) AS placeholder FROM pages""")
def clean_titles(spark, sf_dir):
    k = F.col("page_id")
    raw = F.when(k % 5 == 0, F.lit(" ")).when(k % 5 == 1, F.lit("/runs/x.md")).when(k % 5 == 2, F.concat(F.lit("file:///data/annual_report-"), k, F.lit(".pdf"))).when(k % 5 == 3, F.lit("Plain_title")).otherwise(F.lit("out/Postrag.json"))
    scope = F.when(k % 4 == 0, F.lit(" Pending ")).when(k % 4 == 1, F.lit(None).cast("string")).otherwise(F.lit("eval"))
    return read(spark, sf_dir, "pages").select(k, answers.clean_title(raw).alias("title"), answers.is_internal(raw).alias("internal"), answers.is_placeholder(scope).alias("placeholder"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'Just now' WHEN event_id % 5 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M UTC') END AS shown FROM events")
def human_dates(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("")).when(F.col("event_id") % 5 == 0, F.lit("soon")).otherwise(iso)
    return read(spark, sf_dir, "events").select("event_id", answers.human_date(raw).alias("shown"))


@query(r"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace('  a' || chr(13) || chr(10) || chr(9) || coalesce(text, '') || chr(10) || chr(10) || chr(10) || chr(13) || ' z ', chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def article_texts(spark, sf_dir):
    text = F.concat(F.lit("  a\r\n\t"), F.coalesce("text", F.lit("")), F.lit("\n\n\n\r z "))
    return read(spark, sf_dir, "documents").select("doc_id", answers.article_text(text).alias("text"))


# ---------------------------------------------------------------- usage, JSON in texts, judgements


@query(r"""
    WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
    e AS (SELECT *, greatest(1, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 13 / 10))::BIGINT AS words, greatest(1, floor(length(text) / 4))::BIGINT AS chars FROM t)
    SELECT conv_id, turn, words, chars, CASE WHEN turn % 3 = 0 THEN turn + 1 ELSE words END AS input_tokens, CASE WHEN turn % 3 = 1 THEN 50 ELSE words END AS output_tokens,
        CASE WHEN turn % 3 = 2 THEN 7 ELSE CASE WHEN turn % 3 = 0 THEN turn + 1 ELSE words END + CASE WHEN turn % 3 = 1 THEN 50 ELSE words END END AS total_tokens FROM e""")
def token_estimates(spark, sf_dir):
    t = F.col("turn")
    usage = F.when(t % 3 == 0, F.concat(F.lit('{"prompt_tokens": '), t + 1, F.lit(', "input_tokens": 0}'))).when(t % 3 == 1, F.lit('{"completion_tokens": 50}')).otherwise(F.lit('{"estimated_total_tokens": 7}'))
    counts = records.usage_counts(usage, F.col("text"), F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", records.estimated_tokens(F.col("text")).alias("words"), records.estimated_text_tokens(F.col("text")).alias("chars"), *(c.alias(n) for n, c in counts.items()))


@query("""
    SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN event_id % 100 WHEN event_id % 2 = 0 THEN 9 END AS input_tokens, CASE WHEN event_id % 3 = 2 THEN 4 END AS output_tokens, NULL::BIGINT AS total_tokens,
        CASE event_id % 3 WHEN 0 THEN '{"n":1}' WHEN 1 THEN '{}' ELSE '{"m":2}' END AS usage FROM events""")
def response_usage(spark, sf_dir):
    k = F.col("event_id")
    inner = F.when(k % 3 == 1, F.when(k % 2 == 0, F.lit('"prompt_tokens": 9')).otherwise(F.lit('"prompt_tokens": "9x"'))).otherwise(F.concat(F.lit('"prompt_tokens": 3, "input_tokens": '), k % 100))
    text = F.concat(F.lit('{"usage": {'), inner, F.when(k % 3 == 2, F.lit(', "completion_tokens": 4')).otherwise(F.lit("")), F.lit("}}"))
    other = F.when(k % 3 == 0, F.lit('{"tokens": {"n": 1}, "cost": 2}')).when(k % 3 == 1, F.lit('{"usage": 3}')).otherwise(F.lit('{"usage": [1], "ledger": {"m": 2}}'))
    return read(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in records.response_usage(text).items()), records.usage_record(other).alias("usage"))


JSON_TEXT = """CASE item_id % 5 WHEN 0 THEN '{"answer": " ", "response": "r' || item_id || '"}' WHEN 1 THEN '```json' || chr(10) || '{"a": 1}' || chr(10) || '```' WHEN 2 THEN 'so: {"b": {"c": 2}} done' WHEN 3 THEN 'no json' ELSE '{"x": 1} and {"y": 2}' END"""


@query(f"""
    WITH t AS (SELECT item_id, {JSON_TEXT} AS j FROM benchmark)
    SELECT item_id, nullif(regexp_extract(j, '(?s)\\{{.*\\}}'), '') AS object, CASE item_id % 5 WHEN 0 THEN j WHEN 1 THEN '{{"a": 1}}' WHEN 2 THEN '{{"b": {{"c": 2}}}}' END AS parsed,
        CASE WHEN item_id % 5 = 0 THEN 'r' || item_id ELSE j END AS answer FROM t""")
def json_in_texts(spark, sf_dir):
    j = F.expr(JSON_TEXT.replace("chr(10)", "char(10)"))
    return read(spark, sf_dir, "benchmark").select("item_id", records.json_object(j).alias("object"), records.parsed(j).alias("parsed"), records.answer_text(j).alias("answer"))


@query(f"""
    WITH t AS (SELECT item_id, item_id % 7 AS k FROM benchmark)
    SELECT item_id, {", ".join(f"CASE WHEN k = 6 THEN NULL WHEN k = 5 AND {i} = 2 THEN NULL ELSE (item_id + {i}) % 6 END::INTEGER AS {m}" for i, m in enumerate(evals.METRICS))},
        CASE WHEN k = 6 THEN 'no scores' ELSE coalesce({", ".join(f"CASE WHEN k = 5 AND {i} = 2 THEN 'no whole number for {m}' WHEN (item_id + {i}) % 6 = 0 THEN '{m} out of range' END" for i, m in enumerate(evals.METRICS))}) END AS problem FROM t""")
def judge_scores(spark, sf_dir):
    """Scores read from a judge's answer, and what is wrong with them."""
    k = F.col("item_id")
    score = lambda i: F.when((k % 7 == 5) & F.lit(i == 2), F.lit('"good"')).otherwise(((k + i) % 6).cast("string"))
    body = F.concat_ws(", ", *(F.concat(F.lit(f'"{m}": '), score(i)) for i, m in enumerate(evals.METRICS)))
    text = F.when(k % 7 == 6, F.lit('{"verdict": "none"}')).otherwise(F.concat(F.lit('Here: {"scores": {'), body, F.lit("}}")))
    scores, problem = records.judgement(text, evals.METRICS)
    return read(spark, sf_dir, "benchmark").select("item_id", *(c.alias(m) for m, c in scores.items()), problem.alias("problem"))


# ---------------------------------------------------------------- candidates

RECORD = """concat('{', CASE WHEN p_partkey % 4 = 0 THEN '"canonical_name": "Canon ' || p_name || '", ' ELSE '' END, '"name": "', p_name, '", "type": "Product", "description": "a ', p_type, '", "predicate": "made_of", "head_id": "h', p_partkey, '"',
    ', "provenance": [{"evidence_id": "ev_', p_partkey % 7, '", "quote": " q', p_size, ' "}, {"evidence_id": "ev_1", "quote": " "}, {"quote": "z"}], "postrag_evidence": [{"evidence_id": "ev_2"}]',
    ', "postrag": {"used_evidence_ids": ["ev_3", "ev_1"]}, "event_date": "2024", "temporal": {"valid_from": "2020", "event_date": ""}, "aliases": ["x","y"], "attributes": {"size":1}}')"""
NAME_SQL = "CASE WHEN p_partkey % 4 = 0 THEN 'Canon ' || p_name ELSE p_name END"
DISTINCT_SQL = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query(rf"""
    WITH t AS (SELECT p_partkey, p_size, {NAME_SQL} AS name, ['ev_2', 'ev_' || (p_partkey % 7), 'ev_1'] AS two, ['ev_2', 'ev_' || (p_partkey % 7), 'ev_1', 'ev_3', 'ev_1'] AS three, {RECORD} AS r FROM part)
    SELECT p_partkey, name AS entity_name, 'Product' AS entity_type, 'product::' || lower(name) AS entity_key, 'Product' AS relation_type, 'h' || p_partkey AS subject_id, '' AS object_id, '2024' AS event_date, '2020' AS valid_from, NULL::VARCHAR AS valid_to,
        array_to_string({DISTINCT_SQL.format('three')}, ',') AS evidence_ids, array_to_string({DISTINCT_SQL.format('two')}, ',') AS candidate_ids, 'q' || p_size || ',z' AS quotes,
        name AS entity_id, sha256(r) AS relation_id FROM t""")
def candidate_fields(spark, sf_dir):
    """Names, types, ends, dates, evidence and ids of candidate records."""
    r = F.expr(RECORD)
    subject, obj = records.relation_ends(r)
    listed = lambda c: F.array_join(c, ",")
    return read(spark, sf_dir, "part").select(
        "p_partkey", records.entity_name(r).alias("entity_name"), records.entity_type(r).alias("entity_type"), records.entity_key(r).alias("entity_key"), records.relation_type(r).alias("relation_type"),
        subject.alias("subject_id"), obj.alias("object_id"), *(c.alias(n) for n, c in records.temporal(r).items()), listed(records.evidence_ids(r)).alias("evidence_ids"), listed(records.candidate_evidence_ids(r)).alias("candidate_ids"),
        listed(records.provenance_quotes(r)).alias("quotes"), records.candidate_id(r, "entity").alias("entity_id"), records.candidate_id(r, "relation").alias("relation_id"),
    )


QUOTES_SQL = """'[" q' || p_size || ' ", " ", "z"]'"""


@query(rf"""
    WITH t AS (SELECT *, {NAME_SQL} AS name FROM part)
    SELECT p_partkey, concat_ws(chr(10), 'name: ' || name, 'type: Product', 'aliases: ["x","y"]', 'description: a ' || p_type, 'attributes: {{"size":1}}', 'temporal: {{"valid_from":"2020","event_date":""}}', 'provenance_quotes: ' || {QUOTES_SQL}) AS entity,
        concat_ws(chr(10), 'subject: ' || p_brand, 'relation_type: Product', 'object: o', 'description: a ' || p_type, 'attributes: {{"size":1}}', 'temporal: {{"event_date": "2024", "valid_from": "2020", "valid_to": null}}', 'provenance_quotes: ' || {QUOTES_SQL}) AS claim,
        concat_ws(chr(10), 'block_type: table', 'metadata: {{}}', 'text: ' || p_name) AS evidence FROM t""")
def embedding_texts(spark, sf_dir):
    r = F.expr(RECORD)
    return read(spark, sf_dir, "part").select("p_partkey", records.entity_text(r).alias("entity"), records.claim_text(r, F.col("p_brand"), F.lit("o")).alias("claim"), records.evidence_text(F.lit("table"), F.lit(None).cast("string"), F.col("p_name")).alias("evidence"))


@query(rf"""
    WITH t AS (SELECT *, {NAME_SQL} AS name FROM part)
    SELECT p_partkey, '{{"aliases":"[\"x\",\"y\"]","attributes":"{{\"size\":1}}","canonical_name":"' || name || '","description":"a ' || p_type || '","entity_type":"Product","evidence_quotes":["q' || p_size || '","z"],"kind":"entity","temporal":"{{\"valid_from\":\"2020\",\"event_date\":\"\"}}"}}' AS query,
        name || '|Product|x,y|{{"size":1}}|q' || p_size || ',z' AS compact FROM t""")
def candidate_queries(spark, sf_dir):
    r = F.expr(RECORD)
    c = records.compact_candidate(r, "entity")
    shown = F.concat_ws("|", c["canonical_name"], c["entity_type"], F.array_join(c["aliases"], ","), c["attributes"], F.array_join(c["provenance_quotes"], ","))
    return read(spark, sf_dir, "part").select("p_partkey", records.candidate_query(r, "entity").alias("query"), shown.alias("compact"))


@query("""
    SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 95.0 WHEN 1 THEN 55 WHEN 2 THEN 60 WHEN 3 THEN 100 ELSE 50 END::DOUBLE AS bar, CASE s_suppkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'medium' END AS tone,
        'reject' AS decision, CAST(0.32 AS DOUBLE) AS grounding_score FROM supplier""")
def risk_bars(spark, sf_dir):
    k = F.col("s_suppkey")
    bar, tone = records.risk_bar(F.when(k % 5 == 0, "Very High").when(k % 5 == 1, " moderate").when(k % 5 == 2, "3").when(k % 5 == 3, "140.5").otherwise("odd"))
    f = verdicts.fallback(F.lit("no answer"))
    return read(spark, sf_dir, "supplier").select(k, bar.alias("bar"), tone.alias("tone"), f["decision"].alias("decision"), f["grounding_score"].alias("grounding_score"))


@query("""
    SELECT item_id, 'ask --q ' || CASE WHEN item_id % 2 = 0 THEN 'plain/' || item_id ELSE '''it''"''"''s ' || item_id || '''' END || ' raw ' || CASE WHEN item_id % 2 = 0 THEN 'plain/' || item_id ELSE 'it''s ' || item_id END AS command,
        'a,b,' || item_id AS listed, 'x,' || item_id AS strings FROM benchmark""")
def filled_templates(spark, sf_dir):
    k = F.col("item_id")
    q = F.when(k % 2 == 0, F.concat(F.lit("plain/"), k)).otherwise(F.concat(F.lit("it's "), k))
    listed = records.listed(F.concat(F.lit(" a, b,,a , "), k))
    strings = records.unique_strings(F.array(F.lit("x "), F.lit(None), F.lit(" "), k.cast("string"), F.lit("x")))
    return read(spark, sf_dir, "benchmark").select(k, records.filled_template(F.lit("ask --q {question} raw {question_raw}"), {"question": q}).alias("command"), F.array_join(listed, ",").alias("listed"), F.array_join(strings, ",").alias("strings"))


@query("""
    SELECT page_id, 'artifact_source_' || page_id AS id, CASE WHEN page_id > 9 THEN 'S' ELSE CAST(page_id AS VARCHAR) END AS logo, CASE page_id % 3 WHEN 0 THEN 'My report' WHEN 1 THEN 'A house' ELSE 'Source ' || page_id END AS title,
        CASE WHEN page_id % 3 = 0 THEN '2024-05' ELSE 'Date unavailable' END AS date, CASE WHEN page_id % 3 = 1 THEN 'high' ELSE 'Source' END AS tag FROM pages""")
def source_cards(spark, sf_dir):
    k = F.col("page_id")
    r = F.when(k % 3 == 0, F.lit('{"document": {"title": "My_report", "date": "2024-05"}}')).when(k % 3 == 1, F.lit('{"document": {"name": " ", "publisher": "A-house", "credibility": {"tier": "high"}}}')).otherwise(F.lit("not json"))
    return read(spark, sf_dir, "pages").select(k, records.source_card(r, k).alias("c")).select("page_id", "c.*")


# ---------------------------------------------------------------- contracts


@query(f"""
    WITH t AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN '-bad id' ELSE 'src_' || page_id END AS source_id, CASE WHEN page_id % 5 = 0 THEN ' ' ELSE url END AS source, {pick_sql('page_id', ['url', 'pdf', 'odd'])} AS kind FROM pages)
    SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 6 = 0 THEN 'source_id is not an id' END, CASE WHEN kind = 'odd' THEN 'source_kind is not known: odd' END, CASE WHEN trim(source) = '' THEN 'source is empty' END], lambda x: x IS NOT NULL), '; ') AS problems FROM t""")
def contract_sources(spark, sf_dir):
    k = F.col("page_id")
    rows = read(spark, sf_dir, "pages").select(
        k, F.when(k % 6 == 0, "-bad id").otherwise(F.concat(F.lit("src_"), k)).alias("source_id"), F.when(k % 5 == 0, " ").otherwise(F.col("url")).alias("source"), F.col("url").alias("canonical_source"), pick("page_id", ["url", "pdf", "odd"]).alias("source_kind"),
        F.lit("acquired").alias("acquisition_status"), F.lit("c1").alias("corpus_id"), F.lit("b.1").alias("branch_id"), F.lit(None).cast("string").alias("duplicate_of"),
    )
    return contracts.checked(rows, "source").select("page_id", F.array_join("problems", "; ").alias("problems"))


@query(f"""
    WITH t AS (SELECT event_id, {pick_sql('event_id', ['acquire', 'extract', 'dance'])} AS stage, {pick_sql('event_id', ['hit', 'miss', 'odd', 'write', 'error'])} AS cache FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN stage = 'dance' THEN 'stage is not known: dance' END, CASE WHEN cache = 'odd' THEN 'cache_status is not known: odd' END, CASE WHEN event_id % 4 = 1 THEN 'source_id is not an id' END,
        CASE WHEN event_id % 9 = 0 THEN 'operation is empty' END], lambda x: x IS NOT NULL), '; ') AS problems FROM t""")
def contract_ledger(spark, sf_dir):
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        k, F.lit("run_1").alias("run_id"), pick("event_id", ["acquire", "extract", "dance"]).alias("stage"), pick("event_id", ["hit", "miss", "odd", "write", "error"]).alias("cache_status"),
        F.when(k % 4 == 1, "?").when(k % 4 == 2, "s1").alias("source_id"), F.when(k % 9 != 0, "chat").alias("operation"),
    )
    return contracts.checked(rows, "ledger").select("event_id", F.array_join("problems", "; ").alias("problems"))


@query("""
    SELECT event_id % 8 AS kind, count(*) AS n, CASE event_id % 8 WHEN 1 THEN 'completed_stages has an unknown stage' WHEN 2 THEN 'status is not known: nothing' WHEN 3 THEN 'failed_stage is not known' WHEN 4 THEN 'run_id is not an id' ELSE '' END AS problems FROM events GROUP BY ALL""")
def contract_statuses(spark, sf_dir):
    k = F.col("event_id") % 8
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "events").select(
        k.alias("kind"), F.lit("s1").alias("source_id"), F.when(k == 2, "nothing").otherwise("success").alias("status"), F.when(k == 1, F.array(F.lit("acquire"), F.lit("sing"))).when(k == 5, F.array(F.lit("ingest"))).alias("completed_stages"),
        F.array(F.lit("sarg")).alias("skipped_stages"), F.when(k == 3, "paint").alias("failed_stage"), F.when(k == 4, " ").alias("run_id"), none.alias("corpus_id"), none.alias("branch_id"), none.alias("duplicate_of"),
    )
    return contracts.checked(rows, "status").groupBy("kind", F.array_join("problems", "; ").alias("problems")).agg(F.count("*").alias("n"))


@query("""
    SELECT page_id % 4 AS kind, count(*) AS good FROM pages WHERE page_id % 4 NOT IN (1, 2) GROUP BY 1""")
def contract_split(spark, sf_dir):
    """Good manifest rows apart from those whose status or kind is not known."""
    k = F.col("page_id")
    rows = read(spark, sf_dir, "pages").select(
        (k % 4).alias("kind"), F.col("url").alias("source"), F.col("url").alias("canonical_source"), F.concat(F.lit("s"), k).alias("source_id"), F.when(k % 4 == 1, "film").otherwise("url").alias("source_kind"),
        F.lit("c").alias("corpus_id"), F.lit("b").alias("branch_id"), F.when(k % 4 == 2, "lost").otherwise("acquired").alias("acquisition_status"),
    )
    return contracts.split(rows, "manifest")[0].groupBy("kind").agg(F.count("*").alias("good"))
