"""A stored positional index: the text vectors of a chunk table, by lexeme.

A row holds one lexeme's occurrences in one block of ``block_ids`` consecutive chunk ids: ``id_gap`` is the
distance of an occurrence's chunk id from that of the one before it (the first: from the block's start), ``pos_gap``
the distance of its position from the one before it in the same chunk (the first of a chunk: the position).
Blocks begin at the same ids for all lexemes, so a match never leaves its block, and a lexeme that a third of
all chunks hold is many small rows. Files are partitioned by epoch and by bucket (hash of the lexeme), and
sorted by lexeme and block. Only texts are exchanged to write them, by block; the task that codes a block writes its rows.

A search reads no chunk text:
  query lexemes --(lexeme)--> headers ``(lexeme, block, max_tf)``, no arrays --> blocks that hold all lexemes
  --(lexeme, block)--> their arrays, each once, hash by block --> intersected and scored in numpy by set of lexemes
(query lexemes too many to broadcast: arrays by (query, block); all matches: no headers, all arrays of the lexemes)

Epochs make the index extendable: ``write_epoch`` under a name that is there already replaces that epoch, so a
replayed batch counts once; a chunk id belongs to one epoch. Null texts and null ids have no postings; rows that repeat an id and text count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.functions.numeric import round_half_up
from ragloom.operators import ingest, lexical, sizing, stopwords

BLOCK_IDS = 256
BUCKETS = 32
RUN_BLOCKS = 4096  # blocks of a bucket that are written together
TASKS_OF = 2  # shuffle partitions that one coding task stands for
SCHEMA = "tok string, block long, n_chunks int, max_tf int, id_gap array<int>, pos_gap array<int>, epoch string, bucket int"


def _bucket(tok, n_buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(tok), F.lit(n_buckets)).cast("int")


def encode(postings: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Postings ``(chunk_id, pos, tok)`` as rows of lexeme and block; one exchange, of occurrences."""
    block = F.expr(f"(chunk_id - pmod(chunk_id, {block_ids})) div {block_ids}")
    # id and position in one long: numbers sort and compare without a walk over structs
    place = (F.expr(f"pmod(chunk_id, {block_ids})") * F.lit(1 << 32)).cast("long") + F.col("pos").cast("long")
    occ = postings.where(F.col("chunk_id").isNotNull()).select("tok", block.alias("block"), place.alias("place"))
    rows = occ.groupBy("tok", "block").agg(F.sort_array(F.collect_set("place")).alias("o"))
    rows = rows.select("tok", "block", "o", F.concat(F.array(F.lit(-1).cast("long")), F.slice("o", 1, F.size("o") - 1)).alias("p"))
    ids = lambda x: F.shiftright(x, 32)
    low = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))
    id_gap = F.zip_with("o", "p", lambda x, y: (ids(x) - F.greatest(ids(y), F.lit(0))).cast("int"))
    pos_gap = F.zip_with("o", "p", lambda x, y: F.when(ids(x) == ids(y), x - y).otherwise(low(x)).cast("int"))
    # places at which a chunk begins; the most occurrences in a chunk is the widest step between them
    begins = F.filter(F.transform("o", lambda x, i: F.when(ids(x) != ids(F.element_at("p", i + 1)), i)), lambda i: i.isNotNull())
    rows = rows.select("tok", "block", id_gap.alias("id_gap"), pos_gap.alias("pos_gap"), begins.alias("b"), F.size("o").alias("n"))
    width = F.zip_with("b", F.concat(F.slice("b", 2, F.size("b")), F.array("n")), lambda x, y: y - x)
    return rows.select("tok", "block", F.size("b").alias("n_chunks"), F.array_max(width).alias("max_tf"), "id_gap", "pos_gap")


class _Stops:
    """Stop words and stems as a task uses them on the distinct words of some texts. ``stems``: ``config``, ``tok`` and ``stem`` as Arrow."""

    def __init__(self, stems: pa.Table | None):
        self.stops = {c: pa.array(ws, pa.string()) for c, ws in stopwords.word_lists().items()}
        self.stems = {}
        for c in pc.unique(stems["config"]).to_pylist() if stems is not None else ():
            rows = stems.filter(pc.equal(stems["config"], c))
            self.stems[c] = rows["tok"].combine_chunks(), rows["stem"].combine_chunks()

    def apply(self, words: pa.Array, code: np.ndarray, config: np.ndarray):
        """``words`` with the stems, and for each token its code in them, or -1 for a stop word."""
        code = code.copy()
        for c in pd.unique(config):
            rows = np.flatnonzero(config == c) if c is not None else ()
            if len(rows) == 0 or c not in self.stops and c not in self.stems:
                continue
            to = np.arange(len(words))
            if c in self.stops:
                to[pc.is_in(words, self.stops[c]).to_numpy(zero_copy_only=False)] = -1
            if c in self.stems:
                toks, stems = self.stems[c]
                at = pc.index_in(words, toks)
                has = pc.is_valid(at).to_numpy(zero_copy_only=False) & (to >= 0)
                used = np.zeros(len(words), dtype=bool)
                used[code[rows]] = True
                has = np.flatnonzero(has & used)
                to[has] = len(words) + np.arange(len(has))
                words = pa.concat_arrays([words, stems.take(at.take(pa.array(has)))])
            code[rows] = to[code[rows]]
        return words, code


def _encode_run(ids: np.ndarray, toks: pa.Array, config: np.ndarray | None, words_of: _Stops | None, block_ids: int) -> pa.RecordBatch | None:
    """Rows of lexeme and block of the chunks of whole blocks."""
    order = np.argsort(ids, kind="stable")
    ids, toks = ids[order], toks.take(pa.array(order))
    lens = pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
    found = toks.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(ids)), lens)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens) + 1
    code, words = found.indices.to_numpy().astype(np.int64), found.dictionary
    if words_of is not None:
        words, code = words_of.apply(words, code, config[order][row])
        keep = code >= 0
        row, pos, code = row[keep], pos[keep], code[keep]
    if len(code) == 0:
        return None
    words = words.dictionary_encode()  # a stem may be a word too
    code = words.indices.to_numpy().astype(np.int32)[code]
    at = ids[row]
    repeated = len(ids) > 1 and bool((ids[1:] == ids[:-1]).any())
    # by lexeme, id and position: they come by id and position, but for rows that repeat an id
    order = np.lexsort((pos, at, code)) if repeated else np.argsort(code, kind="stable")
    code, at, pos = code[order], at[order], pos[order]
    if repeated:
        fresh = np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1]) | (pos[1:] != pos[:-1])]
        code, at, pos = code[fresh], at[fresh], pos[fresh]
    block = at // block_ids
    new_row = np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])]
    new_chunk = new_row | np.r_[True, at[1:] != at[:-1]]
    starts, begins = np.flatnonzero(new_row), np.flatnonzero(new_chunk)
    id_gap = np.diff(at, prepend=0)
    id_gap[starts] = at[starts] - block[starts] * block_ids
    pos_gap = np.where(new_chunk, pos, np.diff(pos, prepend=0))
    tf = np.diff(np.r_[begins, len(pos)])
    top = np.maximum.reduceat(tf, np.searchsorted(begins, starts))
    n_chunks = np.add.reduceat(new_chunk.astype(np.int64), starts)
    ends = pa.array(np.r_[starts, len(pos)].astype(np.int32))
    int32 = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [words.dictionary.take(pa.array(code[starts])), pa.array(block[starts]), int32(n_chunks), int32(top),
         pa.ListArray.from_arrays(ends, int32(id_gap)), pa.ListArray.from_arrays(ends, int32(pos_gap))],
        ["tok", "block", "n_chunks", "max_tf", "id_gap", "pos_gap"])


def _encode_batches(bc, block_ids: int):
    def fn(batches):
        words_of = None if bc is None else _Stops(None if bc.value is None else pa.ipc.open_stream(bc.value).read_all())

        def runs(rows: pa.Table, last: bool):
            """Whole blocks, a bounded number of tokens (or a block) at a time; what may go on stays."""
            blocks = rows["block"].to_numpy()
            begins = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            lens = pc.list_value_length(rows["toks"]).to_numpy().astype(np.int64)
            whole = len(begins) if last else len(begins) - 1
            bounds = np.r_[begins, len(blocks)]
            out = []
            for i, j in sizing.pieces(np.add.reduceat(lens, begins)[:whole], lexical.SLICE_TOKENS):
                part = rows.slice(bounds[i], bounds[j] - bounds[i]).combine_chunks()
                config = None if words_of is None else np.asarray(part["config"].to_pylist(), dtype=object)
                toks = part["toks"].combine_chunks()
                made = _encode_run(part["chunk_id"].to_numpy(), toks, config, words_of, block_ids)
                if made is not None:
                    out.append(made)
            return out, rows.slice(bounds[whole])

        held = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            if batch.column("block")[0] == batch.column("block")[-1] and held[0].column("block")[0] == batch.column("block")[-1]:
                continue  # the block goes on
            out, rest = runs(pa.Table.from_batches(held), False)
            yield from out
            held = rest.combine_chunks().to_batches()
        if held:
            yield from runs(pa.Table.from_batches(held), True)[0]

    return fn


def encode_texts(chunks: DataFrame, block_ids: int = BLOCK_IDS, fold_accents: bool = True, config_col: str | None = None,
                 stems: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """As ``encode``, of whole texts: the texts of a block meet (one exchange, of texts) and a task codes a bounded number of
    tokens (or a block) at a time. A block has at most ``block_ids`` different chunk ids. With ``config_col``, stop words are left
    out and, with ``stems`` (that fit a broadcast), the others are stems."""
    spark, bc = chunks.sparkSession, None
    if config_col:
        if stems is not None:
            sink, found = pa.BufferOutputStream(), stems.select("config", "tok", "stem").toArrow()
            with pa.ipc.new_stream(sink, found.schema) as w:
                w.write_table(found)
        bc = spark.sparkContext.broadcast(None if stems is None else sink.getvalue().to_pybytes())
    block = F.expr(f"(chunk_id - pmod(chunk_id, {block_ids})) div {block_ids}")
    config = [F.col(config_col).alias("config")] if config_col else []
    texts = chunks.where("chunk_id is not null and content is not null").select(
        F.col("chunk_id").cast("long").alias("chunk_id"), "content", *config).withColumn("block", block)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(n, "block").sortWithinPartitions("block")
    return texts.select("chunk_id", "block", T.tokens("content", fold_accents=fold_accents).alias("toks"), *(["config"] if config_col else [])).mapInArrow(
        _encode_batches(bc, block_ids), "tok string, block long, n_chunks int, max_tf int, id_gap array<int>, pos_gap array<int>")


def write_epoch(chunks: DataFrame, path: str, epoch: str = "0", config_col: str | None = None, fold_accents: bool = True,
                block_ids: int = BLOCK_IDS, stems: DataFrame | None = None) -> None:
    """Add the chunks ``(chunk_id, content)`` to the index at ``path`` as one epoch, which replaces an earlier
    one of its name. With ``config_col``, stop words of each chunk's configuration are left out and, with ``stems``
    (a dictionary of ``stemming``), the others are stems."""
    if stems is not None and not config_col:
        raise ValueError("stems belong to a configuration: name config_col")
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if stems is not None and sizing.measured_bytes(stems, "config", "tok", "stem") > sizing.broadcast_limit(stems):
        rows = encode(stopwords.config_postings(chunks, config_col=config_col, fold_accents=fold_accents, stems=stems), block_ids)
        # one more exchange by bucket and run of blocks, without sampling: a frequent lexeme's blocks are spread over the runs
        rows = rows.withColumn("bucket", _bucket("tok")).repartition(n, "bucket", F.floor(F.col("block") / F.lit(RUN_BLOCKS)))
    else:
        # the rows stay in the tasks that coded them, fewer than for an exchange, so that a bucket has few files
        parts = max(n // TASKS_OF, min(n, chunks.sparkSession.sparkContext.defaultParallelism))
        rows = encode_texts(chunks, block_ids, fold_accents, config_col, stems, parts).withColumn("bucket", _bucket("tok"))
    with sizing.shuffles_freed(rows.sparkSession):
        (rows.withColumn("epoch", F.lit(epoch)).sortWithinPartitions("epoch", "bucket", "tok", "block")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("epoch", "bucket").parquet(path))


def write_with_chunks(rows: DataFrame, path: str, index_path: str, reset: bool, strategy: str, epoch: str = "0", **kw) -> None:
    """A7 + E3: a strategy's chunk rows and their text vectors, replaced (``reset``) or added as ``epoch``."""
    ingest.write_chunks(rows, path, reset, strategy=strategy)
    rows = rows.where(F.col("strategy") == strategy)
    folder = f"{index_path}/strategy={strategy}"
    if reset:  # the earlier epochs go, also where there are no new rows
        rows.sparkSession.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(folder)
    write_epoch(rows, folder, epoch, **kw)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index at ``path``: an empty folder or one whose chunks had no words is an empty index."""
    return spark.read.schema(SCHEMA).parquet(path)


def build(chunks: DataFrame, **kw) -> DataFrame:
    """The chunks' index as a table in the shared scratch folder."""
    import uuid

    from ragloom.session import scratch_path

    path = scratch_path(chunks.sparkSession, f"text_index/{uuid.uuid4().hex}")
    write_epoch(chunks, path, **kw)
    return read(chunks.sparkSession, path)


# ------------------------------------------------------------------ search

def _small(df: DataFrame, limit: int | None, *text_cols: str) -> DataFrame:
    """``df`` marked for broadcast if its measured bytes fit."""
    return F.broadcast(df) if sizing.measured_bytes(df, *text_cols) <= sizing.broadcast_limit(df, limit) else df


def _asked(index: DataFrame, qlex: DataFrame) -> DataFrame:
    """The folders that hold the query lexemes: at most ``BUCKETS`` numbers reach the driver."""
    wanted = [r.b for r in qlex.select(_bucket("tok").alias("b")).distinct().collect()]
    return index.where(F.col("bucket").isin(wanted))


def candidate_blocks(index: DataFrame, qlex: DataFrame, limit: int | None = None) -> DataFrame:
    """``(query_id, block, reach)``: blocks that hold all lexemes of a query, from headers alone. No chunk of the
    block ranks above ``COVER_WEIGHT * reach``.

    ``reach`` is the number of lexemes times the least of their ``max_tf``. Every minimal cover holds an occurrence
    of each lexeme, and two minimal covers that share one never begin with the same lexeme (the earlier would hold that
    lexeme twice and not be minimal), so an occurrence of the rarest lexeme is in at most as many covers as there are
    lexemes, each worth ``COVER_WEIGHT`` at most."""
    heads = _asked(index, qlex).select("tok", "block", "max_tf").join(_small(qlex, limit, "tok"), "tok")
    # a block that two epochs filled has a header in each
    per = heads.groupBy("query_id", "block", "li").agg(F.max("n_lex").alias("n_lex"), F.sum("max_tf").alias("tf"))
    return per.groupBy("query_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_lex").alias("n_lex"), F.min("tf").alias("tf")
    ).where("n = n_lex").select("query_id", "block", (F.col("n_lex") * F.col("tf")).alias("reach"))


def _decode(block: np.ndarray, lens: np.ndarray, gap: np.ndarray, step: np.ndarray, block_ids: int):
    """Rows of one or more lexemes, their gaps one after another, as flat arrays: row number, chunk id, position."""
    row = np.repeat(np.arange(len(block)), lens)
    first = np.r_[0, np.cumsum(lens)[:-1]]
    gap, step = gap.astype(np.int64), step.astype(np.int64)
    total = np.cumsum(gap)
    chunk = total - (total[first] - gap[first])[row] + block[row] * block_ids
    begins = gap != 0
    begins[first] = True
    at = np.flatnonzero(begins)
    total = np.cumsum(step)
    pos = total - (total[at] - step[at])[np.cumsum(begins) - 1]
    return row, chunk, pos


def _score_blocks(block_ids: int):
    def score(pdf: pd.DataFrame):
        row, chunk, pos = _decode(pdf["block"].to_numpy(), pdf["id_gap"].map(len).to_numpy(), np.concatenate(pdf["id_gap"].to_list()),
                                  np.concatenate(pdf["pos_gap"].to_list()), block_ids)
        q, li, n_lex = (pdf[c].to_numpy()[row] for c in ("query_id", "li", "n_lex"))
        # chunks that hold every lexeme, before positions are sorted
        seen = pd.DataFrame({"q": q, "c": chunk, "li": li, "n": n_lex})
        have = seen.drop_duplicates(["q", "c", "li"]).groupby(["q", "c"], sort=False).agg(k=("li", "size"), n=("n", "first"))
        whole = have.index[(have["k"] == have["n"]).to_numpy()]
        keep = pd.MultiIndex.from_arrays([q, chunk]).isin(whole)
        if not keep.any():
            return None
        occ = pd.DataFrame({"query_id": q[keep], "chunk_id": chunk[keep], "pos": pos[keep], "li": li[keep], "n_lex": n_lex[keep]})
        return lexical._score_frame(occ.sort_values(["query_id", "chunk_id", "pos"], kind="stable"))

    def fn(batches):
        carry = None
        for pdf in batches:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if len(pdf) == 0:
                continue
            q, b = pdf["query_id"].to_numpy(), pdf["block"].to_numpy()
            cut = int(np.argmax((q == q[-1]) & (b == b[-1])))  # the last block may go on in the next batch
            carry, done = pdf.iloc[cut:], pdf.iloc[:cut]
            out = score(done) if len(done) else None
            if out is not None:
                yield out
        out = score(carry) if carry is not None and len(carry) else None
        if out is not None:
            yield out

    return fn


def score_blocks(index: DataFrame, qlex: DataFrame, blocks: DataFrame, block_ids: int = BLOCK_IDS, limit: int | None = None) -> DataFrame:
    """Matches ``(query_id, chunk_id, rank_bm25)`` of the given ``(query_id, block)`` pairs; only their arrays move."""
    need = blocks.select("query_id", "block").join(_small(qlex, limit, "tok"), "query_id")
    arrays = _asked(index, qlex).select("tok", "block", "id_gap", "pos_gap").join(_small(need, limit, "tok"), ["tok", "block"])
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    srt = arrays.repartition(n, "query_id", "block").sortWithinPartitions("query_id", "block")
    out = srt.select("query_id", "block", "li", "n_lex", "id_gap", "pos_gap").mapInPandas(
        _score_blocks(block_ids), "query_id long, chunk_id long, score double")
    return out.select("query_id", "chunk_id", round_half_up("score", lexical.RANK_DIGITS).alias("rank_bm25"))


def _score_runs(bc, block_ids: int):
    """Rows of whole blocks: arrays of lexemes and, if only some sets are asked of a block, rows that name those."""
    table, k, picked = bc.value
    numbers = pd.Index(table.set_id)

    def score(rows: pa.Table):
        asked = None
        if picked:
            named = pc.is_valid(rows["set_id"])
            sets, rows = rows.filter(named), rows.filter(pc.invert(named))
            asked = sets["block"].to_numpy(), numbers.get_indexer(sets["set_id"].to_numpy())
        if rows.num_rows == 0:
            return
        block, lens = rows["block"].to_numpy(), pc.list_value_length(rows["id_gap"]).to_numpy().astype(np.int64)
        begins = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        bounds, code = np.r_[begins, len(block)], rows["code"].to_numpy()
        # a block at a time if each is asked for sets of its own, else a bounded number of occurrences (or a block)
        for i, j in sizing.pieces(np.add.reduceat(lens, begins), 0 if picked else lexical.EXPANDED):
            lo, hi = bounds[i], bounds[j]
            flat = [rows[c].slice(lo, hi - lo).combine_chunks().flatten().to_numpy() for c in ("id_gap", "pos_gap")]
            row, chunk, pos = _decode(block[lo:hi], lens[lo:hi], *flat, block_ids)
            only = asked and asked[1][np.searchsorted(asked[0], block[lo]):np.searchsorted(asked[0], block[lo], side="right")]
            yield from lexical.score_sets(table, chunk, code[lo:hi][row], pos, only)

    def parts(batches):
        held = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            if held[0].column("block")[0] == batch.column("block")[-1]:
                continue  # the block goes on
            rows = pa.Table.from_batches(held).combine_chunks()
            block = rows["block"].to_numpy()
            cut = int(np.searchsorted(block, block[-1]))  # the last block may go on in the next batch
            yield from score(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield from score(pa.Table.from_batches(held).combine_chunks())

    def fn(batches):
        for s, c, r in lexical.best_of_task(parts(batches), k):
            yield pa.RecordBatch.from_arrays([pa.array(table.set_id[s]), pa.array(c), pa.array(r)], ["set_id", "chunk_id", "score"])

    return fn


def score_sets(index: DataFrame, sets: DataFrame, table: lexical.SetTable, blocks: DataFrame | None = None, k: int | None = None,
               block_ids: int = BLOCK_IDS, limit: int | None = None) -> DataFrame:
    """Matches ``(set_id, chunk_id, rank_bm25)`` of all sets, or of the ``(set_id, block)`` pairs given. The arrays
    of the lexemes asked for meet by block, each once however many sets ask for it, and a task scores block by block."""
    spark = index.sparkSession
    codes = spark.createDataFrame(pd.DataFrame({"tok": table.vocab.to_numpy(), "code": np.arange(len(table.vocab))}), "tok string, code long")
    arrays = _asked(index, codes).select("tok", "block", "id_gap", "pos_gap")
    if blocks is not None:
        toks = sets.where("set_id = query_id").select("set_id", F.explode("toks").alias("tok"))
        need = sizing.materialize(blocks.select("set_id", "block").join(_small(toks, limit, "tok"), "set_id").select("tok", "block").distinct())
        arrays = arrays.join(_small(need, limit, "tok"), ["tok", "block"], "left_semi")
    rows = arrays.join(_small(codes, limit, "tok"), "tok").select("block", "code", "id_gap", "pos_gap")
    if blocks is not None:
        rows = rows.withColumn("set_id", F.lit(None).cast("long")).unionByName(
            blocks.select("block", "set_id"), allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bc = spark.sparkContext.broadcast((table, k, blocks is not None))
    out = rows.repartition(n, "block").sortWithinPartitions("block").mapInArrow(
        _score_runs(bc, block_ids), "set_id long, chunk_id long, score double")
    return out.select("set_id", "chunk_id", round_half_up("score", lexical.RANK_DIGITS).alias("rank_bm25"))


def _lexemes(queries: DataFrame, query_config_col: str | None, stems: DataFrame | None) -> DataFrame:
    if query_config_col:
        return sizing.materialize(lexical.query_lexemes_config(queries, config_col=query_config_col, stems=stems))
    return sizing.materialize(lexical.query_lexemes(queries))


def lexical_match(index: DataFrame, queries: DataFrame, query_config_col: str | None = None, block_ids: int = BLOCK_IDS,
                  limit: int | None = None, stems: DataFrame | None = None) -> DataFrame:
    """F4 + F5 from the index: every match with its rank."""
    qlex = _lexemes(queries, query_config_col, stems)
    if sizing.fits_broadcast(qlex, row_bytes=64, limit=limit):
        sets = lexical.lexeme_sets(qlex)
        return lexical.members(score_sets(index, sets, lexical.SetTable(sets), block_ids=block_ids, limit=limit), sets)
    return score_blocks(index, qlex, sizing.materialize(candidate_blocks(index, qlex, limit)), block_ids, limit)


def topk_and_reads(index: DataFrame, queries: DataFrame, k: int = C.LEXICAL_CANDIDATES, query_config_col: str | None = None,
                   block_ids: int = BLOCK_IDS, first: int = 4, grow: int = 4, rounds: int = 3,
                   limit: int | None = None, stems: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """F6 from the index, exact: the ``k`` best matches of each query, and ``(query_id, n_blocks, n_read)``.

    A query's candidate blocks are taken by (reach desc, block): ``first`` of them, then ``grow`` times as many, for
    ``rounds`` rounds, then all that are left. Before each round, blocks are left out whose best possible row comes after
    the query's k-th so far: bound below its rank, or equal to it with later ids."""
    qlex = _lexemes(queries, query_config_col, stems)
    sets = table = None
    if sizing.fits_broadcast(qlex, row_bytes=64, limit=limit):  # a set of lexemes is searched once, under its least query
        sets = lexical.lexeme_sets(qlex)
        table = lexical.SetTable(sets)
        qlex = qlex.join(_small(sets.where("set_id = query_id").select("query_id"), limit), "query_id", "left_semi")
    cand = sizing.materialize(candidate_blocks(index, qlex, limit))
    spark = cand.sparkSession
    top = spark.createDataFrame([], "query_id long, chunk_id long, rank_bm25 double, rank long")
    at = spark.createDataFrame([], "query_id long, r long, b long")  # how far each query has come
    read_pairs = []
    for i in range(rounds + 1):
        kth = top.where(F.col("rank") == k).select("query_id", F.col("rank_bm25").alias("s"), F.col("chunk_id").alias("c"))
        state = sizing.materialize(at.join(kth, "query_id", "left"))
        bound = round_half_up(F.lit(C.COVER_WEIGHT) * F.col("reach"), lexical.RANK_DIGITS)
        later = F.col("r").isNull() | (F.col("reach") < F.col("r")) | ((F.col("reach") == F.col("r")) & (F.col("block") > F.col("b")))
        hopeless = (bound < F.col("s")) | ((bound == F.col("s")) & (F.col("block") * block_ids > F.col("c")))
        left = cand.join(_small(state, limit), "query_id", "left").where(later & ~F.coalesce(hopeless, F.lit(False))).select(*cand.columns)
        if i < rounds:
            left = lexical.top_k(left, first * grow ** i, "reach", tie="block").drop("rank")
        picks = sizing.materialize(left)
        if picks.isEmpty():
            break
        read_pairs.append(picks)
        if sets is None:
            found = score_blocks(index, qlex, picks, block_ids, limit)
        else:
            found = score_sets(index, sets, table, picks.withColumnRenamed("query_id", "set_id"), k, block_ids, limit)
            found = found.withColumnRenamed("set_id", "query_id")
        top = sizing.materialize(lexical.top_k(top.drop("rank").unionByName(found), k, "rank_bm25"))
        last = picks.groupBy("query_id").agg(F.min(F.struct("reach", (-F.col("block")).alias("nb"))).alias("m")).select(
            "query_id", F.col("m.reach").cast("long").alias("r"), (-F.col("m.nb")).alias("b"))
        at = at.join(last.select("query_id"), "query_id", "left_anti").unionByName(last)
    n_read = cand.limit(0).select("query_id")
    for p in read_pairs:
        n_read = n_read.unionByName(p.select("query_id"))
    reads = cand.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks")).join(
        n_read.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_read")), "query_id")
    if sets is not None:
        top, reads = (lexical.members(x.withColumnRenamed("query_id", "set_id"), sets) for x in (top, reads))
    return top, reads


def lexical_topk(index: DataFrame, queries: DataFrame, k: int = C.LEXICAL_CANDIDATES, **kw) -> DataFrame:
    """F6 from the index: the ``k`` best cover-density matches per query (rank desc, chunk_id asc)."""
    return topk_and_reads(index, queries, k, **kw)[0]
