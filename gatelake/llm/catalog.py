"""Queries of this package, and SQL where DuckDB can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, divergence, langid, line_dedup, ngram_join, packing, pii, prefix_trie, search, substring_dedup, suffix_dedup, warc
from .common import read_table, staged

#: The demonstration key of the registered query; real jobs pass their own.
PII_KEY = b"gatelake demonstration key"


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, then read every record back by the index."""
    index = warc.write(read_table(spark, sf_dir, "pages"))
    return warc.read(index, folder=index.folder_path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language from a model of the documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", F.size("pii").alias("n_values"), F.array_sort(F.array_distinct("pii.kind")).alias("kinds"))


QUERIES = {f.__name__: f for f in (op2_warc, op5_packing, op7_language_id, op9_pii)}

ORACLE: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
        n AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top,
                     rpad(hex, 40, '0') AS h FROM d),
        digits AS (SELECT page_id, payload_bytes, top,
                     list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)) AS c FROM n)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(c, '') AS payload_digest,
               CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to
        FROM digits
    """,
}


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark passage."""
    out = decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


QUERIES["op4_decontamination"] = op4_decontamination
ORACLE["op4_decontamination"] = r"""
    WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS k
            FROM iw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM win),
    hits AS (SELECT d.doc_id, d.s, win.n, win.item_id FROM
               (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM
                  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)) d
             JOIN win ON win.k = d.k AND win.n = d.n),
    hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
    hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under 4-word shingle Jaccard of 0.85 or more."""
    return ngram_join.join_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES["op10_ngram_join"] = op10_ngram_join


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that start anywhere else, too."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), keep_first=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word windows that start earlier, too."""
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


QUERIES |= {"op3_suffix_dedup": op3_suffix_dedup, "op6_substring_dedup": op6_substring_dedup}


ORACLE["op6_substring_dedup"] = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r
            FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda s: md5_number(array_to_string(w[s:s + 19], ' ')))) AS k, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM win WHERE r > 1),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
ORACLE["op3_suffix_dedup"] = r"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    win AS (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM (SELECT doc_id, unnest(list_transform(range(n - 199), lambda s: md5_number(substr(h, 2 * s + 1, 400)))) AS k, unnest(range(n - 199)) AS s FROM d WHERE n >= 200)),
    hit AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM win WHERE c > 1),
    part AS (SELECT doc_id, s, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM hit),
    span AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM part GROUP BY doc_id, g),
    cut AS (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, n, n FROM d),
    kept AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS x, a AS y FROM cut),
    text AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS t FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
    sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
    FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN text USING (doc_id)
"""
ORACLE["op10_ngram_join"] = r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, md5_number(t) AS k FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda s: array_to_string(w[s:s + 3], ' '))) AS t FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id WHERE 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n) GROUP BY ALL),
    link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
    edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
    reach AS (SELECT x, y FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) USING (doc_id)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that equal, or nearly equal, an earlier one."""
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "kept_sha256")


QUERIES["op8_line_dedup"] = op8_line_dedup


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each whole document whose id is divisible by 100."""
    docs = read_table(spark, sf_dir, "documents")
    found = search.top_k(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


QUERIES["op1_search"] = op1_search
ORACLE["op1_search"] = r"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS t FROM documents),
    tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
    dl AS (SELECT doc_id, coalesce(sum(tf), 0)::DOUBLE AS dl FROM documents LEFT JOIN tf USING (doc_id) GROUP BY doc_id),
    s AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
    idf AS (SELECT t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, s GROUP BY t, n),
    sc AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
           FROM tf q JOIN tf d USING (t) JOIN idf USING (t) JOIN dl ON dl.doc_id = d.doc_id, s WHERE q.doc_id % 100 = 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc)
    SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, their first turns taken from their families' heads."""
    turns = prefix_trie.numbered(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.grafted(turns), turns.select("conv_id").distinct()).nodes


QUERIES["op11_conversation_trie"] = op11_conversation_trie
ORACLE["op11_conversation_trie"] = r"""
    WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT DISTINCT conv_id FROM o),
    bits AS (SELECT conv_id, conv_id::VARCHAR AS s FROM ids),
    h AS (SELECT conv_id, conv_id - (conv_id % 20 + 20) % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ord(s[i])::BIGINT)),
              lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h FROM bits),
    r AS (SELECT o.conv_id, o.i + 10 AS k, role, text FROM o JOIN h USING (conv_id) WHERE i > h
          UNION ALL SELECT h.conv_id, o.i AS k, role, text FROM h JOIN o ON o.conv_id = h.base WHERE i <= h),
    t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, text, md5(octet_length(encode(role))::VARCHAR || ':' || role || text) AS x FROM r),
    p AS (SELECT conv_id, d, text, md5(string_agg(x, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM t
          UNION ALL SELECT conv_id, 0, '', '' FROM ids),
    last AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
    n AS (SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) END AS saved FROM p GROUP BY k, d),
    up AS (SELECT n.k, n.depth, n.conv_id, n_convs, saved, q.k AS parent FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.d = n.depth - 1),
    kids AS (SELECT parent AS k, count(*) AS c FROM up WHERE depth > 0 GROUP BY parent),
    ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p JOIN last USING (conv_id, d) GROUP BY k),
    sub AS (SELECT a.k, sum(x.saved) AS saved, count(*) FILTER (kids.c IS NULL) AS leaves FROM n x JOIN p a ON a.conv_id = x.conv_id AND a.d <= x.depth LEFT JOIN kids ON kids.k = x.k GROUP BY a.k)
    SELECT up.conv_id, up.depth::BIGINT AS depth, f.conv_id AS parent_conv_id, up.n_convs::BIGINT AS n_convs, coalesce(kids.c, 0)::BIGINT AS n_children, sub.leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
    FROM up JOIN sub USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k) LEFT JOIN n f ON f.k = up.parent
"""


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted, stored, and read back from what was stored."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], turns.schema)
    return chat_format.read_back(staged(chat_format.formatted(turns.unionByName(tricky)), "formatted"))


QUERIES["op12_chat_format"] = op12_chat_format
ORACLE["op12_chat_format"] = r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, length(regexp_replace(regexp_replace(text, '(\[)(\\*/?(INST|SYS|ROLE|TURN)\])', '\1\\\2', 'g'), '(<)(\\*/?s>)', '\1\\\2', 'g'))
                  + CASE role WHEN 'assistant' THEN 5 WHEN 'user' THEN 18 WHEN 'system' THEN 16
                         ELSE 33 + length(regexp_replace(regexp_replace(role, '(\[)(\\*/?(INST|SYS|ROLE|TURN)\])', '\1\\\2', 'g'), '(<)(\\*/?s>)', '\1\\\2', 'g')) END AS size FROM c),
    g AS (SELECT conv_id, count(*) AS n, sum(size) AS size, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
                 coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss FROM e GROUP BY conv_id)
    SELECT conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, size::BIGINT AS formatted_chars FROM g
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's terms against its language, and against each other source."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES["op13_source_divergence"] = op13_source_divergence
ORACLE["op13_source_divergence"] = r"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, t, count(*) AS n, count(DISTINCT i) AS docs FROM (SELECT i, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
    kept AS (SELECT lang, t, sum(n) AS n FROM c GROUP BY lang, t HAVING sum(docs) >= 3),
    v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    own AS (SELECT c.lang, c.source, c.t, c.n FROM c JOIN kept USING (lang, t)),
    total AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY lang, source),
    p AS (SELECT g.lang, g.source, kept.t, coalesce(own.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 1)) // (coalesce(total.total, 0) + v)::HUGEINT AS p
          FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.t = kept.t),
    q AS (SELECT kept.lang, kept.t, 1 + (1000000000::HUGEINT * (n + 1)) // (v.total + v)::HUGEINT AS q FROM kept JOIN v USING (lang)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
    pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
    term AS (SELECT p.lang, p.source, p.t AS item, (p - q) * (p - q) // q AS value FROM p JOIN q ON p.lang = q.lang AND p.t = q.t WHERE n > 0 AND p > q),
    both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
