"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.llm.common import hold_out
from quillstack.session import materialise, read_table

RANKS = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
#: One or two lines that hold so many words are a run of lines too.
PASSAGE_WORDS = 50


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_bitmask(spark, folder):
    from quillstack.llm import language

    docs = read_table(spark, folder, "documents")
    held = hold_out(F.col("doc_id"), 3) == 1
    filters = language.train(docs.filter(~F.coalesce(held, F.lit(False))))
    found = language.predict(docs, filters)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def mixing_stage(spark, docs, folder):
    """The documents sampled to the target mix. Null and empty texts have no token and
    no topic of their own; an empty table stays empty."""
    from quillstack.llm import mixing

    return mixing.mix(docs).filter("kept").select(*docs.columns)


def op2_raked_mixture(spark, folder):
    from quillstack.llm import mixing

    return mixing.mix(read_table(spark, folder, "documents")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


def op3_projected_neighbours(spark, folder):
    from quillstack.llm import neighbours

    return neighbours.search(read_table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def _toxicity_model(spark, folder):
    """Learned from labelled documents outside the held-out fifth, wherever it is used."""
    from quillstack.llm import toxicity

    held = hold_out(F.col("doc_id"), 5) == 0
    labels = read_table(spark, folder, "labels").filter(~held & F.col("toxic").isNotNull())
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.train(docs.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id"))


def toxicity_stage(spark, docs, folder):
    """The documents that are not predicted to be toxic. Null and empty texts are scored
    like others, repeated rows fare alike, columns of any name stay, and an empty table
    stays empty. Without labels nothing is rejected."""
    return _toxicity_model(spark, folder).accepted(docs)


def op4_toxicity(spark, folder):
    docs = read_table(spark, folder, "documents")
    return _toxicity_model(spark, folder).score(docs).select(
        "doc_id", F.coalesce(hold_out(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def encode_stage(spark, docs, folder):
    """Ids of the whole texts, decoded again, as digests. Null and empty texts have no
    ids; null and repeated ids and repeated rows stay; an empty table stays empty."""
    import public_tokenizers

    from quillstack.llm import byte_bpe

    encoded = byte_bpe.encode(docs, _tokenizer(RANKS), public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark, folder):
    return encode_stage(spark, read_table(spark, folder, "documents"), folder)


def op6_phrase_automata(spark, folder):
    from quillstack.llm import phrase_dedup

    return phrase_dedup.remove_repeats(read_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_whole_token_counts(spark, folder):
    from quillstack.llm import token_counts

    return token_counts.count_tokens(read_table(spark, folder, "documents"), _tokenizer(WORD_BPE))


def op8_host_rules(spark, folder):
    from quillstack.llm import host_rules

    return host_rules.judge(read_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def near_duplicate_stage(spark, docs, folder):
    """One document of each group of similar texts: the one of smallest id. Texts are
    similar here at 0.8 on sets of five words; op9 has its own contract.

    A document is known by its id and a hash of its text, so null and repeated ids do no
    harm: an id comes before no id, then the smaller hash counts. Of rows that agree in
    both, one stays. Null, empty and wordless texts resemble nothing and all stay. An
    empty table stays empty; columns of any name are kept."""
    from quillstack.llm import jaccard_join

    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    found = jaccard_join.join(docs.select(key.alias("key"), "text"), "key", percent=80, width=5)
    first = materialise(found.filter("key = component_id").groupBy("key").agg(
        ((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("repeated")), "near-firsts")
    row = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    single = row.join(first.filter("NOT repeated").select("key"), "key", "left_semi").select("row")
    repeated = materialise(first.filter("repeated").select("key"), "near-repeats")
    order = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), order.alias("order"))
    one = keyed.join(repeated, "key", "left_semi").groupBy("key").agg(F.max_by("row", "order").alias("row")).select("row")
    return single.unionByName(one).select("row.*")


def op9_jaccard_prefixes(spark, folder):
    from quillstack.llm import jaccard_join

    return jaccard_join.join(read_table(spark, folder, "documents"))


def _lines(docs):
    from quillstack.llm import line_dedup

    return line_dedup.dedupe_lines(docs, passage_words=PASSAGE_WORDS)


def line_stage(spark, docs, folder):
    """Repeated runs of lines deleted; documents of which no word is left go with them.
    Null and empty texts stay, as do rows of repeated or null ids and columns of any name
    (rows that agree in id and text are one document); an empty table stays empty."""
    left = _lines(docs).filter((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*docs.columns)


def op10_line_winnowing(spark, folder):
    return _lines(read_table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


def op11_dual_tree_codes(spark, folder):
    from quillstack.llm import vector_codes

    coded, books = vector_codes.compress(read_table(spark, folder, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_letter_count_trees(spark, folder):
    from quillstack.llm import spelling

    return spelling.group_variants(spelling.counted_words(read_table(spark, folder, "documents")))


def op13_subword_quality(spark, folder):
    from quillstack.llm import quality

    held = F.coalesce(hold_out(F.col("doc_id"), 5) == 0, F.lit(False))
    docs = read_table(spark, folder, "documents")
    labels = read_table(spark, folder, "labels").filter(~held)
    known = docs.join(labels.select("doc_id", F.col("quality").alias("_label")), "doc_id")
    model = quality.train(known, F.col("text"), F.col("_label"))
    scored = model.score(docs.select("doc_id", "text"), 1)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {
    "op1_language_bitmask": op1_language_bitmask,
    "op2_raked_mixture": op2_raked_mixture,
    "op3_projected_neighbours": op3_projected_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_phrase_automata": op6_phrase_automata,
    "op7_whole_token_counts": op7_whole_token_counts,
    "op8_host_rules": op8_host_rules,
    "op9_jaccard_prefixes": op9_jaccard_prefixes,
    "op10_line_winnowing": op10_line_winnowing,
    "op11_dual_tree_codes": op11_dual_tree_codes,
    "op12_letter_count_trees": op12_letter_count_trees,
    "op13_subword_quality": op13_subword_quality,
}

SQL: dict[str, str] = {}

SQL["op8_host_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d)),
twice AS (SELECT doc_id, s FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(s, s + 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(lines.n, 0) AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, n_words < 10 AS r1, 100 * n_repeat_words > 20 * n_words AS r2,
         n_symbols > 0.1::DOUBLE * word_chars AS r3, n_dup_lines > 0.3::DOUBLE * n_lines AS r4 FROM m),
long AS (
  SELECT source, unnest([1, 2, 3, 4]) AS r, unnest([r1, r2, r3, r4])::INT AS x FROM f
  WHERE source IS NOT NULL),
h AS (SELECT source, r, count(*) AS n, sum(x) AS x, sum(x) / count(*) AS p FROM long GROUP BY ALL),
pr AS (SELECT r, avg(p) AS m, var_pop(p) - avg(p) * (1 - avg(p)) * avg(1 / n) AS v FROM h GROUP BY r),
rate AS (
  SELECT source, max(CASE WHEN v > 0 THEN (x + s * m) / (n + s) ELSE m END) AS worst
  FROM (SELECT *, greatest(m * (1 - m) / v - 1, 0) AS s FROM h JOIN pr USING (r)) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       r1 OR r2 AS base_failed, NOT (r1 OR r2) AND NOT coalesce(worst > 0.5, false) AS kept
FROM f LEFT JOIN rate USING (source)
"""

SQL["op10_line_winnowing"] = """
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
l AS (
  SELECT doc_id, pos, s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p
  FROM (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM raw)
  WHERE s <> ''),
win AS (
  SELECT doc_id, p, unnest([1, 2, 3]) AS size, unnest([w, w + lead(w, 1) OVER v, 50]) AS words,
         unnest([s, s || chr(10) || lead(s, 1) OVER v,
                 s || chr(10) || lead(s, 1) OVER v || chr(10) || lead(s, 2) OVER v]) AS k
  FROM (SELECT *, len(string_split_regex(s, '[ \\t\\n\\v\\f\\r]+')) AS w FROM l)
  WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
later AS (
  SELECT doc_id, p, size FROM win WHERE k IS NOT NULL AND words >= 50
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS p FROM later),
cut AS (SELECT doc_id, pos FROM gone JOIN l USING (doc_id, p)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY raw.pos) AS t FROM raw ANTI JOIN cut USING (doc_id, pos)
  GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_deleted,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id) g USING (doc_id)
"""


def _vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Lloyd rounds written out one after the other. Points are rows (rid, part, x)."""
    steps, book = [], "c0"
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT rid, part, any_value(x) AS x, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT p.rid, p.part, p.x, c.e,
           list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM p JOIN {book} c USING (part)) GROUP BY rid, part)""")
        if n < rounds:
            steps.append(f"""
m{n} AS (
  SELECT part, e, list(floor_div ORDER BY i) AS x FROM (
    SELECT part, best.e AS e, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
    FROM (SELECT part, best, unnest(x)::BIGINT AS v, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY ALL)
  GROUP BY part, e),
c{n + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{n}.x::BIGINT[], {book}.x) AS x FROM {book} LEFT JOIN m{n} USING (part, e))""")
            book = f"c{n + 1}"
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT rid, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x
  FROM (SELECT rid, v, unnest(range({parts})) AS part FROM kept)),
c0 AS (SELECT part, rid - 1 AS e, x FROM p WHERE rid <= {entries}),{",".join(steps)},
books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM {book}),
coded AS (
  SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid) CROSS JOIN books
"""


SQL["op11_dual_tree_codes"] = _vector_codes_sql()

SQL["op12_letter_count_trees"] = """
WITH RECURSIVE bytes AS (SELECT unnest(range(256)) AS i),
crc AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)
              ORDER BY i) AS t FROM bytes),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_transform(range(len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) AS h
  FROM (SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM runs), crc),
said AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT)
         ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (
  SELECT word, i, left(word, i) AS a, substr(word, i + 2) AS b
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other FROM cut x JOIN cut y USING (i, a, b) WHERE x.word <> y.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = a || b
  UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = a || b),
best AS (
  SELECT near.word, count(*) AS n_near, min({'n': -w.n, 'word': other}) AS b
  FROM near JOIN words w ON w.word = other GROUP BY near.word),
formed AS MATERIALIZED (
  SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 5 * words.n THEN b.word END AS form,
         CASE WHEN -b.n >= 5 * words.n THEN -b.n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, coalesce(form, word) AS root FROM formed
  UNION SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = root WHERE formed.form IS NOT NULL)
SELECT word, formed.form, root, formed.n, formed.n_near, formed.form_n
FROM chain JOIN formed USING (word) JOIN (SELECT word AS root FROM formed WHERE form IS NULL) USING (root)
"""
