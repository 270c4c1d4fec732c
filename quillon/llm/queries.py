"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import conversation_repair, decontamination, external_shuffle, fingerprints, language_id, lexical_search, line_dedup, mixing, ngram_join, pii, token_store, toxicity, url_filters
from quillon.llm._store import Workspace

WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, _table(spark, sf_dir, "documents", "doc_id", "text"))


#: The rules of op2, as its contract states them.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("host", "path", "verdict"))]) for r in URL_RULES])
    rules = spark.range(1).select(F.inline(rows))
    return url_filters.judge_urls(_table(spark, sf_dir, "pages", "page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(spark, _table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return line_dedup.dedup_lines(spark, docs).select("doc_id", "n_lines", "n_removed", "text")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(spark, docs, toxicity.severity_labels(docs, _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))
    return toxicity.score(spark, docs, model)


def tokenizer_definition(path: str | None = None) -> str:
    """The JSON of a tokenizer: of the file at `path`, or of the public 49k word vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").path("store")
    token_store.write_store(spark, _table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer_definition())
    return token_store.read_digests(spark, path)


#: Of the demonstration; a deployment passes its own secret.
PII_KEY = "quillon-demonstration-key"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents", "doc_id", "text"), PII_KEY).select("doc_id", "n_pii", "text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, _table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spark, _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "text")
    light = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("key"))
    mixed = mixing.mix_sources(spark, light, size=F.col("words"), text_key=F.col("key"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "shuffled").path("shards")
    rows = external_shuffle.write_shards(spark, _table(spark, sf_dir, "documents", "doc_id", "text"), path, shards=40)
    text = F.col("record.text")
    return rows.select("record.doc_id", external_shuffle.record_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation_repair.repair(spark, conversation_repair.damage(rows), rows.select("conv_id"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark, _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filters": op2_url_filters,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_token_store": op6_token_store,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_external_shuffle": op11_external_shuffle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lexical_search": op13_lexical_search,
}

#: Distinct five-word shingles of every document: doc_id, s.
SHINGLES = r"""
        words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words)"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE {SHINGLES},
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.least AS component_id
        FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x, min(y) AS least FROM reach GROUP BY x) r ON r.x = d.doc_id
    """,
    "op2_url_filters": """
        WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        ruled AS (SELECT *, CASE
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
    """,
    "op4_line_dedup": """
        WITH lines AS (SELECT rowid AS r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
        bad AS (SELECT line FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 5),
        kept AS (SELECT r, count(*) AS n_lines, count(b.line) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '') AS text FROM lines l LEFT JOIN bad b ON l.line = b.line GROUP BY r)
        SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
        FROM (SELECT *, row_number() OVER () AS r FROM documents) d LEFT JOIN kept k ON d.r = k.r
    """,
    "op9_decontamination": f"""
        WITH {SHINGLES},
        item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
        items AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM item_words),
        sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
        shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM shingles JOIN items USING (s) GROUP BY 1, 2)
        SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 75 * n_item
    """,
    "op12_conversation_repair": r"""
        WITH RECURSIVE crc_table AS (SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
        kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS kind FROM conversations, crc_table),
        damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
        judged AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
            CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM placed),
        counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
            count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
        added(a, b, path) AS (VALUES ('0', '0', ''), ('s', 's', ''), ('u', 'u', ''), ('a', 'a', ''), ('0', 'u', 'u'), ('0', 'a', 'ua'), ('s', 'u', 'u'), ('s', 'a', 'ua'), ('u', 'a', 'a'), ('a', 'u', 'u')),
        moves(a, b) AS (VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
        walk AS (
            SELECT conv_id, 0::BIGINT AS i, '0' AS state, {'cost': 0::BIGINT, 'audit': '', 'path': ''} AS best FROM counted
            UNION ALL
            SELECT conv_id, i, state, min({'cost': cost, 'audit': audit, 'path': path}) FROM (
                SELECT w.conv_id, j.i, CASE WHEN e.edit = 'D' THEN p.b ELSE m.b END AS state,
                    w.best.cost + 3 * length(p.path) + CASE e.edit WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN e.edit <> 'D' AND j.fault = 't' THEN 3 ELSE 0 END AS cost,
                    w.best.audit || repeat('I', length(p.path)) || e.edit AS audit,
                    w.best.path || p.path || CASE WHEN e.edit = 'R' THEN upper(m.b) ELSE e.edit END AS path
                FROM walk w JOIN judged j ON j.conv_id = w.conv_id AND j.i = w.i + 1 JOIN added p ON p.a = w.state
                    JOIN (VALUES ('D'), ('K'), ('R')) e(edit) ON e.edit = 'D' OR j.fault NOT IN ('b', 'd') LEFT JOIN moves m ON m.a = p.b AND e.edit <> 'D'
                WHERE e.edit = 'D' OR e.edit = 'K' AND m.b = j.r OR e.edit = 'R' AND m.b IN ('u', 'a') AND m.b <> j.r)
            GROUP BY conv_id, i, state),
        ended AS (SELECT w.conv_id, min({'cost': best.cost + 3 * length(p.path), 'audit': best.audit || repeat('I', length(p.path)), 'path': best.path || p.path}) AS best
            FROM walk w JOIN counted c ON c.conv_id = w.conv_id AND c.n = w.i JOIN added p ON p.a = w.state WHERE p.b IN ('0', 'a') GROUP BY w.conv_id),
        tokens AS (SELECT conv_id, unnest(t) AS edits, generate_subscripts(t, 1) AS i FROM (SELECT conv_id, regexp_extract_all(best.path, '[ua]*[KDUA]|[ua]+$') AS t FROM ended)),
        lines AS (SELECT t.conv_id, t.i, list_concat(list_transform(string_split(regexp_extract(edits, '^[ua]*'), ''), lambda x: CASE x WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' END),
            [CASE right(edits, 1) WHEN 'K' THEN role || ':' || text WHEN 'U' THEN 'user:' || text WHEN 'A' THEN 'assistant:' || text END]) AS l FROM tokens t LEFT JOIN judged j ON j.conv_id = t.conv_id AND j.i = t.i),
        hashed AS (SELECT conv_id, sha256(array_to_string(flatten(list(list_filter(l, lambda x: x IS NOT NULL) ORDER BY i)), chr(10))) AS h FROM lines GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted USING (conv_id) LEFT JOIN ended USING (conv_id) LEFT JOIN hashed USING (conv_id)
    """,
    "op13_lexical_search": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        sizes AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
        whole AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM sizes),
        held AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, whole GROUP BY term, nd),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        scored AS (SELECT item_id, r, s.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN sizes s USING (r), whole GROUP BY item_id, r, s.doc_id),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 10
    """,
}
