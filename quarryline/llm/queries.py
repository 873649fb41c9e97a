"""One query for each operator, over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import toxicity
from quarryline.llm.bpe import bpe_decode, bpe_encode
from quarryline.llm.chat import link_calls
from quarryline.llm.common import table
from quarryline.llm.decontamination import leaks
from quarryline.llm.jaccard import near_duplicates
from quarryline.llm.linedup import dedup_lines
from quarryline.llm.phrases import collocations
from quarryline.llm.pii import digest, personal_data
from quarryline.llm.repetition import repetition_rules
from quarryline.llm.tokenfile import token_file
from quarryline.llm.vectorcodes import product_codes
from quarryline.llm.viterbi import sp_decode, sp_encode
from quarryline.llm.warc import warc_round_trip


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers; QUARRYLINE_TOKENIZERS names another folder."""
    if folder := os.environ.get("QUARRYLINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, and the verdict from the maximal repeats, of every document."""
    return repetition_rules(table(spark, sf_dir, "documents"))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves no remainder by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; labels of held-out documents are not learnt from."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(~held_out())))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the class that links of 0.8 on five-word shingles connect it to, and its number of links."""
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, width=5)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more documents have, as a digest."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each page, written to WARC files and read back from them."""
    return warc_round_trip(table(spark, sf_dir, "pages"), min_bytes=0).drop("url")


def op7_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as calls: a user turn calls ``respond``, and the turn after it is the result if an assistant has it. Of
    three user turns the first depends on the last, the second on the first, and the last on the one six turns before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    name = F.concat(F.lit("call-"), F.col("turn").cast("string"))
    arguments = F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt")))
    other = F.when(F.expr("(turn div 2) % 3 = 0"), F.col("turn") + 4).when(F.expr("(turn div 2) % 3 = 1"), F.col("turn") - 2).otherwise(F.col("turn") - 6)
    before = F.array(F.concat(F.lit("call-"), other.cast("string")))
    calls = turns.filter("role = 'user'").select("conv_id", "turn", name.alias("call_id"), F.lit("respond").alias("name"), arguments.alias("arguments"), before.alias("depends_on"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    functions = spark.range(1).select(
        F.lit("respond").alias("name"),
        F.expr("array(named_struct('name', 'prompt', 'type', 'string', 'required', true), named_struct('name', 'turn', 'type', 'integer', 'required', true))").alias("parameters"),
    )
    return link_calls(calls, results, functions)


OP7_SQL = r"""
WITH calls AS (
  SELECT conv_id, turn, 'call-' || turn AS call_id, min(text) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id, turn
), results AS (
  SELECT conv_id, turn, 'call-' || (turn - 1) AS call_id, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS call_turn, r.turn AS result_turn,
       CASE WHEN (c.turn // 2) % 3 = 0 AND last.turn IS NOT NULL THEN c.turn + 5
            WHEN (c.turn // 2) % 3 = 1 AND first.turn IS NOT NULL AND last.turn IS NOT NULL THEN c.turn + 4 ELSE c.turn END AS rank,
       CASE WHEN c.turn IS NULL THEN 'orphan' WHEN c.prompt IS NULL THEN 'invalid' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
       CASE WHEN c.turn IS NOT NULL AND c.prompt IS NULL THEN 'missing:prompt' ELSE '' END AS problems,
       '{"arguments":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE '{"prompt":' || to_json(c.prompt)::VARCHAR || ',"turn":' || c.turn || '}' END
         || ',"content":' || coalesce(to_json(r.content)::VARCHAR, 'null') || ',"id":"' || coalesce(c.call_id, r.call_id)
         || '","name":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE '"respond"' END || '}' AS record
FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
LEFT JOIN calls first ON first.conv_id = c.conv_id AND (c.turn // 2) % 3 = 1 AND first.turn = c.turn - 2
LEFT JOIN calls last ON last.conv_id = c.conv_id AND last.turn = c.turn + 4 - 2 * ((c.turn // 2) % 3)
UNION ALL
SELECT conv_id, 'call-' || (CASE WHEN role = 'user' THEN turn ELSE turn - 1 END), CASE WHEN role = 'user' THEN turn END, CASE WHEN role = 'assistant' THEN turn END,
       NULL, 'duplicate', '',
       '{"arguments":' || CASE WHEN role = 'user' THEN '{' || coalesce('"prompt":' || to_json(text)::VARCHAR || ',', '') || '"turn":' || turn || '}' ELSE 'null' END
         || ',"content":' || CASE WHEN role = 'user' THEN 'null' ELSE coalesce(to_json(text)::VARCHAR, 'null') END
         || ',"id":"call-' || (CASE WHEN role = 'user' THEN turn ELSE turn - 1 END) || '","name":' || CASE WHEN role = 'user' THEN '"respond"' ELSE 'null' END || '}'
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY text) AS nth FROM conversations WHERE role IN ('user', 'assistant')) WHERE nth > 1
"""


def op8_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of the ids of every document, and digests of its text and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = tokenizer_path("piece_bpe_32k.model")
    return sp_decode(sp_encode(docs, model), model).drop("text")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and places of the personal data in every document."""
    return digest(personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids, read back from the token files."""
    return token_file(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op11_phrase_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two to five words of each language, with 100 occurrences or more."""
    return collocations(table(spark, sf_dir, "documents"), max_words=5, min_count=100, absorb=100, top=2000)


def op12_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document, and the digest of the text decoded from them."""
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path), path).drop("text")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector, its label's error, and the digest of the codebooks."""
    return product_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024).drop("label", "codebooks")


#: A document is a row, whatever its id.
OP5_SQL = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM numbered
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), bad AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(bad.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN bad ON keyed.k = bad.k GROUP BY r, doc_id
"""

#: Bits 5 i to 5 i + 4 of a SHA-1 make its base32 digit number i.
OP6_SQL = r"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), coded AS (
  SELECT page_id, strlen(payload) AS payload_bytes, h,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((16 * (instr('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1)
                 + greatest(instr('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1, 0))
                 >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest
  FROM hashed
), ruled AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM coded
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM ruled
"""

QUERIES = {
    "op1_suffix_repetition": op1_suffix_repetition,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_toxic_segments": op3_toxic_segments,
    "op4_chosen_path": op4_chosen_path,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc_shards": op6_warc_shards,
    "op7_tool_links": op7_tool_links,
    "op8_streaming_viterbi": op8_streaming_viterbi,
    "op9_personal_data": op9_personal_data,
    "op10_token_blocks": op10_token_blocks,
    "op11_phrase_bitmaps": op11_phrase_bitmaps,
    "op12_speculative_bpe": op12_speculative_bpe,
    "op13_vector_codes": op13_vector_codes,
}

OP4_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: list_slice(w, i, i + 4)))) AS s
  FROM split WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), wordless AS (
  SELECT doc_id FROM split WHERE len(w) = 0
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * shared.n >= 8 * (x.n + y.n - shared.n)
  UNION ALL SELECT a.doc_id, b.doc_id FROM wordless a JOIN wordless b ON a.doc_id <> b.doc_id
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS class_id,
       (SELECT count(*) FROM links WHERE links.a = d.doc_id) AS n_links
FROM documents d
"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM split, range(1, 6) AS _(k) WHERE len(w) >= k
), counts AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang
), words AS MATERIALIZED (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.k AS size, c.f AS a, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score, cut
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM words) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(w, 1, cut), ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(f) AS f
  FROM words, range(2, 5) AS _(m), range(1, 4) AS __(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_parts p ON p.lang = b.lang AND p.phrase = b.phrase WHERE p.f IS NULL OR 100 * p.f < 100 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def op13_sql(parts: int = 4, rounds: int = 4) -> str:
    """The rounds one after the other; products of small whole numbers are exact in doubles."""
    steps = [
        f"""kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS v FROM kept, range({parts}) AS _(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""far{r} AS MATERIALIZED (
  SELECT vec_id, a.p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (
    SELECT vec_id, a.p, e, list_inner_product(a.v, a.v) - 2 * list_inner_product(a.v, b.v) + list_inner_product(b.v, b.v) AS d
    FROM parts a JOIN book{r} b ON a.p = b.p) a GROUP BY vec_id, a.p
)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT p, e, list(x ORDER BY i) AS v FROM (
      SELECT p, e, i, floor(sum(x) / count(*)) AS x FROM (
        SELECT f.p, f.e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM far{r} f JOIN parts a ON a.vec_id = f.vec_id AND a.p = f.p
      ) GROUP BY p, e, i) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e
)""")
    steps.append(f"""coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM far{rounds} GROUP BY vec_id
), spelt AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM book{rounds})
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), spelt""")
    return "WITH " + ", ".join(steps)


SQL = {
    "op4_chosen_path": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_warc_shards": OP6_SQL,
    "op7_tool_links": OP7_SQL,
    "op11_phrase_bitmaps": OP11_SQL,
    "op13_vector_codes": op13_sql(),
}
