"""Queries of tokens, sentences, cleaning and text scoring, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import cleaning as C
from sievework.functions import sentences as D
from sievework.functions import similarity as M
from sievework.functions import tokens as T
from sievework.functions.python import best_ratio, folded
from sievework.operators import scoring as S
from sievework.operators.duplicates import duplicate_pairs
from sievework.plans.tables import evidence_docs, load, questions


def _digest(tokens: F.Column) -> list:
    return [F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ").cast("binary")).alias("tokens_md5")]


def tokens_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_docs(spark, sf_dir).select("doc_id", *_digest(T.strict_tokens(F.col("text"))))


def tokens_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_docs(spark, sf_dir).select("doc_id", *_digest(T.feature_tokens(F.col("text"))))


def tokens_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_docs(spark, sf_dir).select("doc_id", *_digest(F.array_sort(T.evidence_tokens(F.col("text"), C.EVIDENCE_STOPWORDS))))


def tokens_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_docs(spark, sf_dir).select("doc_id", *_digest(F.array_sort(T.revision_tokens(F.col("text")))))


def tokens_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = evidence_docs(spark, sf_dir).withColumn("folded", folded("text"))
    return docs.select("doc_id", *_digest(F.array_sort(T.lexical_tokens(F.col("folded")))))


def stem_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of all distinct words of the corpus, and of the canonical words."""
    words = evidence_docs(spark, sf_dir).select(F.explode(T.all_of(F.lower("text"), r"[a-z][a-z0-9+-]*")).alias("word"))
    canonical = spark.createDataFrame([(w,) for w in T.CANONICAL], "word string")
    return words.unionByName(canonical).distinct().select("word", T.stem(F.col("word")).alias("stem"))


def numbers_specific_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, found = F.col("text"), F.col("found")
    docs = evidence_docs(spark, sf_dir).withColumn("found", T.numbers(t))
    return docs.select("doc_id", F.array_join(F.array_sort(found), " ").alias("numbers"), T.word_count(t).alias("words"), F.md5(T.compare_text(t).cast("binary")).alias("compare_md5"), F.array_join(F.array_sort(T.specific_terms(t, found=found)), " ").alias("specific"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark text an answer (itself and another, or another), support, and four key points."""
    b = questions(spark, sf_dir)
    n = b.agg(F.count("*")).first()[0]
    other = lambda k, name: b.select(((F.col("item_id") + n - k) % n).alias("item_id"), F.col("text").alias(name))
    met = b.join(other(1, "next"), "item_id").join(other(2, "support"), "item_id").join(other(3, "third"), "item_id")
    words = F.split("text", " ")
    size = F.size(words)
    at = lambda k: F.floor(size * k / 4).cast("int")
    keys = F.array(*[F.array_join(F.slice(words, at(k) + 1, at(k + 1) - at(k)), " ") for k in range(4)])
    answer = F.when(F.col("item_id") % 3 == 0, F.concat_ws(" ", "text", "third")).when(F.col("item_id") % 3 == 1, F.concat_ws(" ", F.substring("text", 1, 90), F.col("next"), F.lit("because the mechanism indicates 42"))).otherwise(F.col("next"))
    return met.select("item_id", answer.alias("answer"), F.col("text").alias("reference"), "support", keys.alias("keys"))


def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine, coverage, Jaccard and token F1 of each answer and its reference."""
    a, r = T.feature_tokens(F.col("answer")), T.feature_tokens(F.col("reference"))
    rows = _answers(spark, sf_dir).select("item_id", a.alias("a"), r.alias("r"), "answer", "reference")
    x, y = F.col("a"), F.col("r")
    return rows.select("item_id", F.round(M.term_cosine(x, y), 6).alias("cosine"), F.round(M.coverage(y, x), 6).alias("coverage"), F.round(M.jaccard(F.array_distinct(x), F.array_distinct(y)), 6).alias("jaccard"), F.round(M.token_f1(F.array_distinct(x), F.array_distinct(y)), 6).alias("token_f1"))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation that duplicate an earlier one."""
    t = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return duplicate_pairs(t, "conv_id", "turn", "text", 0.1)


def sentence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest matching-blocks ratio of each answer's sentences with the reference's."""
    rows = _answers(spark, sf_dir).select("item_id", F.posexplode(D.sentences(F.col("answer"))).alias("place", "sentence"), D.sentences(F.col("reference")).alias("others"))
    return rows.select("item_id", "place", F.round(best_ratio("sentence", "others"), 6).alias("ratio"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_docs(spark, sf_dir).select("doc_id", F.posexplode(D.sentences(F.col("text"))).alias("place", "sentence"))


def claims_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("item_id", F.posexplode(S.claims(F.concat_ws(" ", "answer", "reference"))).alias("place", "claim"))


def chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence_docs(spark, sf_dir).select("doc_id", F.inline(D.evidence_chunks(F.col("text"))))
    return found.select("doc_id", F.col("id").alias("chunk_id"), F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence_docs(spark, sf_dir).lateralJoin(D.Anchors(F.col("text").outer()))
    return found.select("doc_id", "anchor_id", "start", "end", F.sha2("anchor_text", 256).alias("sha256"))


def sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.deduplicated(evidence_docs(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("removed").alias("removed"))


def units_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all documents with the two quality predicates, counted."""
    units = evidence_docs(spark, sf_dir).select("doc_id", F.explode(D.sentences(F.col("text"))).alias("unit"))
    flagged = units.select("doc_id", C.is_science_unit(F.col("unit")).alias("science"), C.is_informative(F.col("unit")).alias("informative"))
    return flagged.groupBy("doc_id").agg(F.count("*").alias("units"), F.count_if("science").alias("science"), F.count_if("informative").alias("informative"))


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    natural, science = C.clean_natural_text(F.col("html")), C.clean_science_text(F.col("html"))
    return pages.select("page_id", F.length(natural).alias("natural_chars"), F.length(science).alias("science_chars"), C.leaks_identifier(natural).alias("leaks"))


def split_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = evidence_docs(spark, sf_dir)
    both = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("claims").alias("kind"), D.sentence_units(F.col("text")).alias("u")), F.struct(F.lit("lists").alias("kind"), D.split_units(D.list_lines(F.col("text"))).alias("u")))).alias("x")).select("doc_id", "x.kind", F.posexplode("x.u").alias("place", "unit"))
    return both.select("doc_id", "kind", "place", F.md5(D.ensured_sentence(F.col("unit")).cast("binary")).alias("unit_md5"), F.length(D.trimmed_at_boundary(F.col("unit"), 120)).alias("trimmed_chars"))


def strict_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.strict_scores(_answers(spark, sf_dir), "answer", "reference", "support", "keys")
    measures = ("key_fraction", "reference_cosine", "reference_coverage", "source_coverage", "specific_coverage", "numeric_coverage", "raw_score")
    return found.select("item_id", "strict_score", *[F.round(c, 4).alias(c) for c in measures], "answer_tokens", "markers", F.array_join("flags", ",").alias("flags"))


def strict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.strict_scores(_answers(spark, sf_dir), "answer", "reference", "support", "keys")
    return found.select("item_id", "evidence_quality", "reasoning_quality", "confidence", "needs_review", F.size("key_points").alias("key_points"))


def answer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.answer_features(_answers(spark, sf_dir), "answer", "reference", "support", "keys")
    return found.select("item_id", "f_tokens", "f_key_fraction", "f_ref_cosine", "f_ref_coverage", "f_source_coverage", "f_specific_coverage", "f_numeric_coverage", "f_markers")


def _rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = S.strict_scores(_answers(spark, sf_dir), "answer", "reference", "support", "keys")
    return S.rescued(S.answer_features(strict, "answer", "reference", "support", "keys"), "answer")


def rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescued(spark, sf_dir).select("item_id", "strict_score", "rescued_score", "rescue_reason", "strong_low_score")


def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir)
    return rows.select("item_id", F.posexplode(S.claim_support(F.col("answer"), F.concat(S.claims(F.col("reference")), F.col("keys")))).alias("place", "support")).select("item_id", "place", F.round("support", 6).alias("support"))


def component_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumn("accepted", F.array("support"))
    found = S.component_rows(rows, "answer", "reference", "support", "keys", "accepted")
    return found.select("item_id", *S.COMPONENTS, "rescue_reason", "soft_gate_score", "item_score")


QUERIES = {
    f.__name__: f
    for f in (
        tokens_strict, tokens_features, tokens_evidence, tokens_revision, tokens_lexical, stem_canonical, numbers_specific_terms, pair_similarity, near_duplicate_pairs, sentence_ratio, sentence_split,
        claims_dedup, chunker, anchors, sentence_dedup, units_quality, html_clean, split_units, strict_score, strict_labels, answer_features, rescue, claim_support, component_row,
    )
}


def _in(words: list[str]) -> str:
    return "('" + "', '".join(words) + "')"


def _norm(e: str, caret: bool = False) -> str:
    e = f"replace({e}, '^-', ' ')" if caret else e
    return f"trim(regexp_replace(lower(regexp_replace({e}, '[^\\x00-\\x7F]+', ' ', 'g')), '[^a-z0-9.+-]+', ' ', 'g'))"


def _science(e: str, stop: list[str], caret: bool) -> str:
    return f"list_filter(list_transform(regexp_extract_all({_norm(e, caret)}, '{T.SCIENCE_PATTERN}'), lambda t: trim(t, '+-')), lambda t: t <> '' AND t NOT IN {_in(stop)} AND NOT regexp_full_match(t, '[a-z]{{1,2}}'))"


def _strict(e: str) -> str:
    return _science(e, T.STRICT_STOPWORDS, True)


_TEXT = "coalesce(text, '')"
_MAP = "MAP([" + ", ".join(f"'{k}'" for k in T.CANONICAL) + "], [" + ", ".join(f"'{v}'" for v in T.CANONICAL.values()) + "])"


def _stem(t: str) -> str:
    cut = "CASE " + " ".join(f"WHEN length({t}) > {len(s) + 4} AND {t} LIKE '%{s}' THEN {t}[:-{len(s) + 1}]" for s in T.SUFFIXES) + f" ELSE {t} END"
    return f"coalesce({_MAP}[{t}], {_MAP}[{cut}], {cut})"


def _feature(e: str) -> str:
    return f"list_transform({_science(e, T.FEATURE_STOPWORDS, False)}, lambda t: {_stem('t')})"


def _numbers(e: str, caret: bool = False) -> str:
    return f"list_distinct(regexp_extract_all({_norm(e, caret)}, '{T.NUMBER_PATTERN}'))"


def _ascii(e: str) -> str:
    """Letters beyond ASCII as '_', so that word boundaries are where Unicode has them."""
    return f"regexp_replace({e}, '[\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{2FF}}\\x{{370}}-\\x{{1FFF}}]', '_', 'g')"


def _specific(e: str, caret: bool = False) -> str:
    return f"list_distinct(list_concat(list_transform(list_filter(regexp_extract_all({_ascii(e)}, '{T.SPECIFIC_PATTERN}'), lambda t: length(t) >= 2), lambda t: lower(t)), {_numbers(e, caret)}))"


def _cover(needles: str, hay: str, empty: str = "0.0") -> str:
    return f"CASE WHEN len(list_distinct({needles})) > 0 THEN len(list_intersect({needles}, {hay})) / len(list_distinct({needles})) ELSE {empty} END"


def _cosine(a: str, b: str) -> str:
    times = lambda of: f"len(list_filter({of}, lambda u: u = t))"
    norm = lambda of: f"sqrt(list_sum(list_transform(list_distinct({of}), lambda t: {times(of)} * {times(of)})))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda t: {times(a)} * {times(b)})), 0) / ({norm(a)} * {norm(b)}) ELSE 0.0 END"


_MD5 = "CAST(len(t) AS INTEGER) AS n_tokens, md5(coalesce(array_to_string(t, ' '), '')) AS tokens_md5"
_ANSWERS = """
    b AS (SELECT item_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), ' ') AS w, (SELECT count(*) FROM benchmark) AS n FROM benchmark),
    m AS (SELECT b.item_id, b.text, b.w, n1.text AS nxt, n2.text AS support, n3.text AS third FROM b JOIN b n1 ON n1.item_id = (b.item_id + 1) % b.n JOIN b n2 ON n2.item_id = (b.item_id + 2) % b.n JOIN b n3 ON n3.item_id = (b.item_id + 3) % b.n),
    ans AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text || ' ' || third WHEN item_id % 3 = 1 THEN text[1:90] || ' ' || nxt || ' because the mechanism indicates 42' ELSE nxt END AS answer, text AS reference, support,
                   list_transform(range(4), lambda k: array_to_string(w[len(w) * k // 4 + 1 : len(w) * (k + 1) // 4], ' ')) AS keys FROM m)"""
_CUT = "regexp_replace(regexp_replace({e}, '([.!?{more}])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g')"


def _sentences(e: str, more: str = "") -> str:
    return f"string_split({_CUT.format(e=e, more=more)}, chr(1))"


_STRICT = f"""
    k AS (SELECT *, {_strict('answer')} AS a, {_strict('reference')} AS r, {_strict('support')} AS s, array_to_string(keys, ' ') AS kj FROM ans),
    kp AS (SELECT *, list_transform(keys, lambda key: struct_pack(t := list_distinct({_strict('key')}), u := {_numbers('key', True)})) AS kt FROM k),
    kv AS (SELECT *, list_transform(kt, lambda x: struct_pack(n := len(x.t), v := greatest(0, least(1, {_cover('x.t', 'a')} + CASE WHEN len(x.u) = 0 THEN 0 WHEN len(list_intersect(x.u, a)) > 0 THEN 0.15 ELSE -0.10 END)))) AS kw FROM kp),
    f AS (SELECT *, list_sum(list_transform(kw, lambda x: CASE WHEN x.v >= 0.56 OR (x.n <= 3 AND x.v >= 0.67) THEN 1.0 WHEN x.v >= 0.30 THEN 0.5 ELSE 0.0 END))::DOUBLE / 4 AS key_fraction, {_cosine('a', 'r')} AS reference_cosine, {_cover('r', 'a')} AS reference_coverage, {_cover('s', 'a')} AS source_coverage,
                 {_specific("reference || ' ' || support || ' ' || kj", True)} AS sp, {_specific('answer', True)} AS sa, {_numbers("reference || ' ' || kj", True)} AS nr, {_numbers('answer', True)} AS na, len(a) AS answer_tokens, len(list_intersect({'[' + _in(S.STRICT_MARKERS)[1:-1] + ']'}, a)) AS markers FROM kv),
    e AS (SELECT *, {_cover('sp', 'sa')} AS specific_coverage, {_cover('nr', 'na')} AS numeric_coverage FROM f),
    g AS (SELECT *, greatest(specific_coverage, 0.65 * source_coverage + 0.35 * numeric_coverage) AS ev, CASE WHEN answer_tokens >= 50 AND markers >= 2 THEN 0.4 WHEN answer_tokens >= 35 AND markers >= 1 THEN 0.3 WHEN answer_tokens >= 20 THEN 0.2 ELSE 0.0 END AS rs FROM e),
    h AS (SELECT *, 2 * key_fraction + 0.8 * greatest(least(reference_cosine / 0.45, 1), least(reference_coverage / 0.45, 1)) + 0.8 * least(ev / 0.45, 1) + rs AS raw_score,
                 list_filter([CASE WHEN answer_tokens < 18 THEN 'very_short_answer_cap_1' END, CASE WHEN key_fraction < 0.25 THEN 'low_key_point_coverage_cap_2' END, CASE WHEN reference_coverage < 0.12 AND reference_cosine < 0.18 THEN 'low_reference_alignment_cap_2' END,
                              CASE WHEN ev < 0.08 AND key_fraction < 0.5 THEN 'weak_article_specific_evidence_cap_2' END, CASE WHEN trim(answer) = '' THEN 'empty_answer' END], lambda x: x IS NOT NULL) AS flags FROM g),
    st AS (SELECT *, greatest(0, least(4, round_even(2 * least(raw_score, CASE WHEN len(flags) = 0 THEN 4 WHEN list_contains(flags, 'empty_answer') THEN 0 WHEN list_contains(flags, 'very_short_answer_cap_1') THEN 1 ELSE 2 END), 0) / 2))::DOUBLE AS strict_score FROM h)"""

_FEATURES = f"""
    fk AS (SELECT item_id, answer AS fanswer, {_feature('answer')} AS a, {_feature("reference || ' ' || array_to_string(keys, ' ')")} AS r, {_feature('support')} AS s, reference || ' ' || array_to_string(keys, ' ') AS rj, support, keys, {_numbers('answer')} AS na FROM ans),
    fx AS (SELECT *, list_transform(keys, lambda key: struct_pack(t := list_distinct({_feature('key')}), u := {_numbers('key')})) AS kt FROM fk),
    fy AS (SELECT *, list_transform(kt, lambda x: struct_pack(n := len(x.t), v := {_cover('x.t', 'a')}, ok := len(x.u) = 0 OR len(list_intersect(x.u, na)) > 0)) AS kw, {_numbers('rj')} AS nr, {_specific("rj || ' ' || support")} AS sp, {_specific('fanswer')} AS sa FROM fx),
    ft AS (SELECT item_id, len(a) AS f_tokens, round(list_sum(list_transform(kw, lambda x: CASE WHEN x.v >= 0.5 AND x.ok THEN 1.0 WHEN x.v >= 0.28 OR (x.n <= 3 AND x.v >= 0.34) THEN 0.5 ELSE 0.0 END))::DOUBLE / 4, 4) AS f_key_fraction, round({_cosine('a', 'r')}, 4) AS f_ref_cosine, round({_cover('r', 'a')}, 4) AS f_ref_coverage,
                  round({_cover('s', 'a')}, 4) AS f_source_coverage, round({_cover('sp', 'sa')}, 4) AS f_specific_coverage, round({_cover('nr', 'na', '1.0')}, 4) AS f_numeric_coverage, len(list_intersect({'[' + _in(S.FEATURE_MARKERS)[1:-1] + ']'}, a)) AS f_markers FROM fy)"""

_SENTENCE_ROWS = f"""
    c AS (SELECT doc_id, list_filter(list_transform({_sentences("coalesce(text, '')")}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS l FROM documents),
    sn AS (SELECT doc_id, unnest(range(len(l))) AS place, unnest(l) AS sentence FROM c)"""

def _evidence(e: str) -> str:
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({e}, '{T.EVIDENCE_PATTERN}'), lambda t: lower(t))), lambda t: t NOT IN {_in(C.EVIDENCE_STOPWORDS)})"


def _any(e: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({e}), '{p}')" for p in phrases) + ")"


#: The two quality predicates of a unit `u`, and the lists of its words that they need.
WORDS_SQL = f"list_transform(regexp_extract_all(u, '{T.EVIDENCE_PATTERN}'), lambda t: lower(t)) AS w, list_transform(regexp_extract_all(u, '[A-Za-z][A-Za-z0-9+./-]*'), lambda t: lower(t)) AS v"
SCIENCE_SQL = f"NOT {_any('u', C.NON_SCIENCE)} AND len(string_split(lower(u), 'table ')) - 1 < 2 AND NOT (len(w) >= 24 AND len(list_distinct(w)) / len(w) < 0.43)"
INFORMATIVE_SQL = f"""(u = '' OR regexp_matches(u, '^(?:\\p{{Lu}}|\\p{{Nd}}|[(\\[])') OR regexp_matches(lower(u), '^(?:p-i-n|n-i-p)')) AND NOT {_any('u', C.GENERIC)} AND NOT regexp_matches({_ascii('u')}, '{C.MALFORMED}') AND len(v) >= 6
    AND NOT (length(u) >= 70 AND NOT regexp_matches({_ascii('u')}, '{C.VERB}')) AND NOT (len(v) >= 24 AND len(list_distinct(v)) / len(v) < 0.40)"""

ORACLE_SQL = {
    "tokens_strict": f"WITH x AS (SELECT doc_id, {_strict(_TEXT)} AS t FROM documents) SELECT doc_id, {_MD5} FROM x",
    "tokens_features": f"WITH x AS (SELECT doc_id, {_feature(_TEXT)} AS t FROM documents) SELECT doc_id, {_MD5} FROM x",
    "tokens_evidence": f"WITH x AS (SELECT doc_id, list_sort({_evidence(_TEXT)}) AS t FROM documents) SELECT doc_id, {_MD5} FROM x",
    "tokens_revision": f"WITH x AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{T.REVISION_PATTERN}'), lambda t: t NOT IN {_in(T.REVISION_STOPWORDS)}))) AS t FROM documents) SELECT doc_id, {_MD5} FROM x",
    "stem_canonical": f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9+-]*')) AS word FROM documents UNION SELECT unnest([{', '.join(repr(w) for w in T.CANONICAL)}])), d AS (SELECT DISTINCT word FROM w) SELECT word, {_stem('word')} AS stem FROM d""",
    "numbers_specific_terms": f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS e FROM documents)
        SELECT doc_id, coalesce(array_to_string(list_sort({_numbers('e')}), ' '), '') AS numbers, CAST(len(regexp_extract_all(e, '\\S+')) AS INTEGER) AS words, md5(trim(regexp_replace(regexp_replace(lower(e), '[^a-z0-9.%+-]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS compare_md5, coalesce(array_to_string(list_sort({_specific('e')}), ' '), '') AS specific FROM x""",
    "pair_similarity": f"""WITH {_ANSWERS}, x AS (SELECT item_id, {_feature('answer')} AS a, {_feature('reference')} AS r FROM ans), y AS (SELECT *, len(list_intersect(a, r)) AS i, len(list_distinct(a)) AS na, len(list_distinct(r)) AS nr FROM x)
        SELECT item_id, round({_cosine('a', 'r')}, 6) AS cosine, round({_cover('r', 'a')}, 6) AS coverage, round(i / greatest(1, na + nr - i), 6) AS jaccard, round(CASE WHEN i > 0 THEN 2.0 * i / (na + nr) ELSE 0.0 END, 6)::DOUBLE AS token_f1 FROM y""",
    "near_duplicate_pairs": f"""WITH t AS (SELECT conv_id, turn, trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS x, {_evidence('text')} AS k FROM conversations),
        p AS (SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, a.x, b.x AS y, a.k, b.k AS l FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn)
        SELECT conv_id, turn_a, turn_b FROM p WHERE x = y OR (least(length(x), length(y)) >= 90 AND (contains(x, y) OR contains(y, x))) OR len(list_intersect(k, l)) / greatest(1, len(k) + len(l) - len(list_intersect(k, l))) >= 0.1""",
    "sentence_split": f"WITH {_SENTENCE_ROWS} SELECT doc_id, CAST(place AS INTEGER) AS place, sentence FROM sn",
    "claims_dedup": f"""WITH {_ANSWERS}, c AS (SELECT item_id, {_sentences("answer || ' ' || reference", ';')} AS l FROM ans), u AS (SELECT item_id, unnest(range(len(l))) AS i, unnest(l) AS claim FROM c),
        t AS (SELECT *, {_feature('claim')} AS t FROM u), k AS (SELECT item_id, i, claim, array_to_string(list_sort(list_distinct(t)), ' ') AS key FROM t WHERE len(t) >= 4),
        n AS (SELECT *, row_number() OVER (PARTITION BY item_id, key ORDER BY i) AS nth FROM k)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS place, claim FROM n WHERE nth = 1""",
    "sentence_dedup": """WITH p AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\n\\s*\\n', chr(1), 'g'), chr(1)) AS l FROM documents), q AS (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS part FROM p),
        c AS (SELECT doc_id, p, list_filter(list_transform(string_split(regexp_replace(part, '([.!?])\\s+([A-Z0-9(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS l FROM q),
        s AS (SELECT doc_id, p, unnest(range(len(l))) AS s, unnest(l) AS sentence FROM c),
        k AS (SELECT *, trim(regexp_replace(lower(trim(regexp_replace(translate(sentence, '‘’“”–—−', '''''""---'), '\\s+', ' ', 'g'))), '[.!?]+$', '')) AS key FROM s),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY p, s) AS nth FROM k), f AS (SELECT *, nth > 1 AND length(key) >= 24 AS gone FROM n),
        j AS (SELECT doc_id, p, string_agg(sentence, ' ' ORDER BY s) FILTER (NOT gone) AS part, count(*) FILTER (gone) AS removed FROM f GROUP BY ALL)
        SELECT doc_id, md5(coalesce(string_agg(part, chr(10) || chr(10) ORDER BY p) FILTER (part IS NOT NULL), '')) AS text_md5, CAST(sum(removed) AS INTEGER) AS removed FROM j GROUP BY doc_id""",
    "units_quality": f"""WITH {_SENTENCE_ROWS}, w AS (SELECT doc_id, sentence AS u, {WORDS_SQL.replace("(u,", "(sentence,")} FROM sn)
        SELECT doc_id, count(*) AS units, count(*) FILTER ({SCIENCE_SQL}) AS science, count(*) FILTER ({INFORMATIVE_SQL}) AS informative FROM w GROUP BY doc_id""",
    "strict_score": f"WITH {_ANSWERS}, {_STRICT} SELECT item_id, strict_score, {', '.join(f'round({c}, 4)::DOUBLE AS {c}' for c in ('key_fraction', 'reference_cosine', 'reference_coverage', 'source_coverage', 'specific_coverage', 'numeric_coverage', 'raw_score'))}, CAST(answer_tokens AS INTEGER) AS answer_tokens, CAST(markers AS INTEGER) AS markers, coalesce(array_to_string(flags, ','), '') AS flags FROM st",
    "strict_labels": f"""WITH {_ANSWERS}, {_STRICT}, l AS (SELECT *, least(key_fraction, greatest(reference_cosine, reference_coverage), greatest(ev, 0.01)) AS sure FROM st),
        lb AS (SELECT *, CASE WHEN len(flags) > 0 OR sure < 0.12 THEN 'low' WHEN sure < 0.25 THEN 'medium' ELSE 'high' END AS confidence FROM l)
        SELECT item_id, CASE WHEN ev >= 0.40 THEN 'strong' WHEN ev >= 0.24 THEN 'adequate' WHEN ev >= 0.10 THEN 'weak' ELSE 'absent' END AS evidence_quality, CASE WHEN rs >= 0.4 THEN 'strong' WHEN rs >= 0.3 THEN 'adequate' WHEN rs >= 0.2 THEN 'weak' ELSE 'absent' END AS reasoning_quality,
               confidence, len(flags) > 0 OR strict_score <= 2.5 OR confidence <> 'high' AS needs_review, CAST(4 AS INTEGER) AS key_points FROM lb""",
    "answer_features": f"WITH {_ANSWERS}, {_FEATURES} SELECT item_id, CAST(f_tokens AS INTEGER) AS f_tokens, f_key_fraction, f_ref_cosine::DOUBLE AS f_ref_cosine, f_ref_coverage::DOUBLE AS f_ref_coverage, f_source_coverage::DOUBLE AS f_source_coverage, f_specific_coverage::DOUBLE AS f_specific_coverage, f_numeric_coverage::DOUBLE AS f_numeric_coverage, CAST(f_markers AS INTEGER) AS f_markers FROM ft",
    "rescue": f"""WITH {_ANSWERS}, {_STRICT}, {_FEATURES}, j AS (SELECT st.item_id, strict_score AS s, flags, answer, round(key_fraction, 4) AS sk, ft.*, greatest(f_ref_cosine, f_ref_coverage) AS ref FROM st JOIN ft USING (item_id)),
        o AS (SELECT *, f_specific_coverage >= 0.25 OR f_numeric_coverage >= 0.45 OR ref >= 0.42 AS ev, ref >= 0.38 OR (f_ref_cosine >= 0.32 AND f_ref_coverage >= 0.28) AS ok, f_key_fraction >= 0.5 OR sk >= 0.5 AS ky FROM j),
        q AS (SELECT *, f_tokens >= 45 AND ok AND ev AND ky AS br, f_tokens >= 55 AND f_key_fraction >= 0.65 AND ref >= 0.35 AND ev AS hi FROM o),
        t AS (SELECT *, greatest(0, least(4, round_even(2 * least(greatest(s, CASE WHEN s <= 2.5 AND br THEN 3.0 ELSE 0.0 END, CASE WHEN s <= 3 AND hi THEN 3.5 ELSE 0.0 END), s + 0.5), 0) / 2)) AS nw, trim(answer) = '' OR list_contains(flags, 'empty_answer') AS em, f_tokens < 22 OR list_contains(flags, 'very_short_answer_cap_1') AS sh FROM q)
        SELECT item_id, s AS strict_score, CASE WHEN s >= 4 OR em OR sh OR nw <= s THEN s ELSE nw END::DOUBLE AS rescued_score,
               CASE WHEN s >= 4 THEN 'already_4' WHEN em THEN 'no_rescue_empty' WHEN sh THEN 'no_rescue_short' WHEN nw <= s THEN 'no_rescue' WHEN s <= 3 AND hi THEN 'v1_high_coverage_to_3_5' ELSE 'v1_science_complete_to_3' END AS rescue_reason,
               hi OR (br AND ref >= 0.45 AND f_specific_coverage >= 0.35) AS strong_low_score FROM t""",
}
