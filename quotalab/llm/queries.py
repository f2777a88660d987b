"""Registered queries of the training-data operators; each applies its operator to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import clustered
from .chat_format import conversation_digests
from .decontaminate import contamination, judged
from .minhash_dedup import near_duplicates
from .ngram_trie import score_texts
from .periodic_runs import periodic_runs
from .piece_lattice import piece_digests
from .quality_gam import classified
from .quality_rules import quality
from .relative_lz import without_windows
from .suffix_dedup import without_repeats
from .token_output import token_digests
from .warc_derivatives import derivatives, responses_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents."""
    out = quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


#: A conversation whose texts hold control strings of chat templates.
MARKED = r"\### Assistant: </turn> ok"


def op2_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted, written and read back."""
    return conversation_digests(_table(spark, sf_dir, "conversations"), [(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)])


def op4_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    out = judged(contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op3_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that no repeated 400-byte string covers."""
    out = without_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_candidates")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    return importlib.import_module("public_tokenizers").path(name)


def op5_zstd_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written with a shared dictionary and read back."""
    return token_digests(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_additive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    out = derivatives(responses_of(_table(spark, sf_dir, "pages")))
    return out.select(
        "page_id", "type", "record_id", "refers_to", "target_uri", "date", "source_digest", "block_digest",
        F.octet_length("block").cast("long").alias("content_length"), F.sha2("block", 256).alias("block_sha256"), F.sha2("record", 256).alias("record_sha256"),
    )


def op8_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents under a trie of triples learnt from nine tenths of them."""
    return score_texts(_table(spark, sf_dir, "documents"))


def op9_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_nbest_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-best piece sequences of all documents, and whether they decode."""
    return piece_digests(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of all embeddings after ten rounds."""
    return clustered(_table(spark, sf_dir, "embeddings"))


def op12_reference_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that no window of 20 words that stood earlier covers."""
    out = without_windows(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def periodic_tails(docs: DataFrame) -> DataFrame:
    """The documents of which every tenth by the hash of its id repeats words up to its end, by the query's contract."""
    d = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    d = d.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    d = d.withColumn("a", F.expr("case when size(w) > 0 then h div 10 % size(w) end")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + h div 10 % 8)"))
    tail = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p + 1 as int)))), ' ')")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def op13_midpoint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, every tenth with a periodic tail."""
    out = periodic_runs(periodic_tails(_table(spark, sf_dir, "documents")))
    # runs come by start and period: of equal exponents the first one stays
    higher = "case when b is null or r.length * b.period > b.length * r.period then r else b end"
    best = F.expr(f"aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> {higher})")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_frequency": op1_line_frequency,
    "op2_schema_fingerprint": op2_schema_fingerprint,
    "op4_suffix_automaton": op4_suffix_automaton,
    "op3_run_length_index": op3_run_length_index,
    "op5_zstd_dictionary": op5_zstd_dictionary,
    "op6_additive_pairs": op6_additive_pairs,
    "op7_derivatives": op7_derivatives,
    "op8_elias_fano_trie": op8_elias_fano_trie,
    "op9_minhash_tensored": op9_minhash_tensored,
    "op10_nbest_lattice": op10_nbest_lattice,
    "op11_partial_distance": op11_partial_distance,
    "op12_reference_blocks": op12_reference_blocks,
    "op13_midpoint_runs": op13_midpoint_runs,
}



def _centroid_sql(rounds: int = 10) -> str:
    """The rounds of op 11 one after the other; x is a component's number and y its integer."""
    assign = """{name} as materialized (
            select vec_id, cluster, distance from (
                select vec_id, cluster, distance, row_number() over (partition by vec_id order by distance, cluster) as place from (
                    select v.vec_id, c.cluster, sum((v.y - c.y) * (v.y - c.y)) as distance from v join {centroids} c using (x) group by v.vec_id, c.cluster))
            where place = 1)"""
    move = """{name} as materialized (
            select c.cluster, c.x, coalesce(m.y, c.y) as y from {centroids} c left join (
                select cluster, x, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) as y from v join {assigned} using (vec_id) group by cluster, x) m
            using (cluster, x))"""
    steps = []
    for k in range(rounds):
        steps += [assign.format(name=f"a{k}", centroids=f"c{k}"), move.format(name=f"c{k + 1}", centroids=f"c{k}", assigned=f"a{k}")]
    steps.append(assign.format(name="last", centroids=f"c{rounds}"))
    return f"""
        with e as (select vec_id, embedding from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = 64),
        v as materialized (select vec_id, unnest(range(1, 65)) as x, unnest(list_transform(embedding, lambda c: floor(1024 * c::double)::hugeint)) as y from e),
        first as (select vec_id, row_number() over (order by sha256('3:' || vec_id)) - 1 as cluster from e qualify cluster < 8),
        c0 as materialized (select cluster, x, y from v join first using (vec_id)),
        {", ".join(steps)},
        d as (select cluster, sha256(string_agg(y::varchar, ',' order by x)) as centroid_sha256 from c{rounds} group by cluster)
        select vec_id, cluster::int as cluster, distance::bigint as distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
            (sum(distance) over ())::bigint as inertia, centroid_sha256
        from last join d using (cluster)
    """


#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_line_frequency": r"""
        with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
        w as (select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, t from d),
        g as (select doc_id, p, list_slice(w, p, p + 7) as win from (select doc_id, w, unnest(range(1, len(w) - 6)) as p from w)),
        again as (select doc_id, win from g group by all having count(*) > 1),
        cover as (select doc_id, count(distinct p + k) as n from (select g.doc_id, g.p, unnest(range(0, 8)) as k from g join again using (doc_id, win)) group by doc_id),
        l as (select doc_id, host, t, line from (select doc_id, host, t, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
        dup as (select doc_id, count(*) - count(distinct line) as n from l group by doc_id),
        norm as (select doc_id, host, t, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) as line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from l),
        hosts as (select host, count(distinct t) as docs from norm group by host),
        often as (select host, line, count(distinct t) as n, min(doc_id) as first from norm group by host, line having count(distinct t) > 50),
        above as (select host, line, first from often join hosts using (host) where 100 * n > 2 * docs),
        gone as (select doc_id, sum(words) as n from norm join above using (host, line) where doc_id <> first group by doc_id),
        c as (
            select w.doc_id, len(w.w)::bigint as n_words,
                (length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')))::bigint as word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
                coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as removed_words
            from w left join dup using (doc_id) left join cover using (doc_id) left join gone using (doc_id))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
            not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not 100 * removed_words > 50 * n_words as kept, removed_words
        from c
    """,
    "op2_schema_fingerprint": r"""
        with c as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
            union all select -7, n, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(n, r)),
        e as (select *, length(t) + length(role) + 14 + len(regexp_extract_all(t, '\\|###|</turn>|: ')) + len(regexp_extract_all(role, '\\|###|</turn>|: ')) as chars from c)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) as turns_sha256,
            coalesce(sum(length(t)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (where role = 'assistant'), '')) as loss_sha256,
            sum(chars)::bigint as formatted_chars
        from e group by conv_id
    """,
    "op4_suffix_automaton": r"""
        with low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from low),
        b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
        i as (select item_id, w, len(w) as n, least(len(w), 13) as k from b where len(w) > 0),
        iw as (select distinct item_id, k, list_slice(w, p, p + k - 1) as win from (select item_id, w, k, unnest(range(1, n - k + 2)) as p from i)),
        dw as (select doc_id, k, p, list_slice(w, p, p + k - 1) as win from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from i))),
        m as (select doc_id, p, dw.k, item_id from dw join iw using (k, win)),
        hit as (select doc_id, count(distinct x) as n from (select doc_id, unnest(range(p, p + k)) as x from (select distinct doc_id, p, k from m)) group by doc_id),
        its as (select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from m) group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(its.n, 0)::bigint as n_items,
            sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) as contaminated
        from d left join hit using (doc_id) left join its using (doc_id)
    """,
    "op11_partial_distance": _centroid_sql(),
    "op12_reference_blocks": r"""
        with d as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        g as materialized (select doc_id, p, list_slice(w, p, p + 19) as win from (select doc_id, w, unnest(range(1, len(w) - 18)) as p from d)),
        least as (select win, min((doc_id, p)) as place from g group by win having count(*) > 1),
        gone as (select distinct doc_id, p + k as i from (select g.doc_id, g.p, unnest(range(0, 20)) as k from g join least using (win) where (g.doc_id, g.p) <> place)),
        words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
        kept as (select doc_id, string_agg(word, ' ' order by i) as t from words anti join gone using (doc_id, i) group by doc_id),
        n as (select doc_id, count(*) as n from gone group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from d left join kept using (doc_id) left join n using (doc_id)
    """,
}
