"""Full-text search: postings, plain query parsing, match, cover-density rank, top-k.

Plan shape (see README "Scale design"):
  query lexemes fit the broadcast bound (checked):
    chunks --mapInArrow--> slices of tokens as codes of the broadcast lexemes, covers scored per
    (set of lexemes, chunk) in numpy, a bounded number at once; only matches (for a top-k, a task's
    best) leave the task (no postings shuffle) and are joined with the queries of their set
  otherwise:
    chunks with a query's rarest lexeme -> those with all its lexemes -> their positions,
    hash by (query, chunk), sorted within partitions -> the same vectorised scoring
  row_number per query <= k (partial WindowGroupLimit before the shuffle)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.functions.numeric import round_half_up
from ragloom.operators import sizing

RANK_DIGITS = 9  # ranking keys are rounded so both engines order equal sums alike


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content",
             fold_accents: bool = True, stop_words: DataFrame | None = None) -> DataFrame:
    """The text vector as rows ``(chunk_id, pos, tok)``; positions are 1-based.

    Stop words (a ``(tok)`` table) are dropped after numbering, so they still use up
    positions, as a text search parser does. ``fold_accents`` is F2 (stored content only).
    """
    p = chunks.select(
        F.col(id_col).alias("chunk_id"),
        F.posexplode(T.tokens(text_col, fold_accents=fold_accents)).alias("pos", "tok"),
    ).select("chunk_id", (F.col("pos") + 1).cast("long").alias("pos"), "tok")
    if stop_words is not None:
        p = p.join(F.broadcast(stop_words.select("tok").distinct()), "tok", "left_anti")
    return p


def query_lexemes(queries: DataFrame, text_col: str = "query_text", fold_accents: bool = False) -> DataFrame:
    """distinct lexemes per query with their index ``li`` and the count ``n_lex``.

    The query text is trimmed (B18) and, faithfully, not accent-folded: an accented
    query word cannot match folded content.
    """
    lex = F.array_distinct(T.tokens(T.py_strip(text_col), fold_accents=fold_accents))
    return queries.select("query_id", lex.alias("lex")).select(
        "query_id", F.size("lex").alias("n_lex"), F.posexplode("lex").alias("li", "tok"))


_BIG = np.int64(1) << np.int64(32)


def _covers_sorted(q, c, pos, li, nlex):
    """Cover density of every (query, chunk) group in arrays sorted by (q, c, pos).

    Per lexeme j, the latest position (and ordinal) of j up to each occurrence is a
    running maximum that restarts with each group; the cover ending at an occurrence
    starts at the minimum of those over the query's lexemes. Returns group starts,
    whether each group matched, and its score (summed in position order).
    """
    n = len(pos)
    new = np.ones(n, dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
    gid = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    r = np.arange(n, dtype=np.int64) - starts[gid] + 1
    base = gid.astype(np.int64) * _BIG
    big = np.iinfo(np.int64).max
    s = np.full(n, big, dtype=np.int64)
    rs = np.full(n, big, dtype=np.int64)
    complete = np.ones(n, dtype=bool)
    for j in range(int(nlex.max()) if n else 0):
        hit = li == j
        lastp = np.maximum.accumulate(base + np.where(hit, pos, 0)) - base
        lastr = np.maximum.accumulate(base + np.where(hit, r, 0)) - base
        active = j < nlex
        complete &= ~active | (lastp > 0)
        s = np.where(active, np.minimum(s, lastp), s)
        rs = np.where(active, np.minimum(rs, lastr), rs)
    prev_ok = np.zeros(n, dtype=bool)
    prev_ok[1:] = ~new[1:] & complete[:-1]
    prev_s = np.zeros(n, dtype=np.int64)
    prev_s[1:] = s[:-1]
    minimal = complete & (~prev_ok | (s > prev_s))
    contrib = np.where(minimal, C.COVER_WEIGHT / (1.0 + (pos - s) - (r - rs)), 0.0)
    ends = np.r_[starts[1:], n] - 1
    score = np.add.reduceat(contrib, starts) if n else np.zeros(0)
    return starts, complete[ends] if n else np.zeros(0, dtype=bool), score


def _cover_density_batches(batches):
    carry = None
    for pdf in batches:
        if carry is not None:
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if len(pdf) == 0:
            continue
        q, c = pdf["query_id"].to_numpy(), pdf["chunk_id"].to_numpy()
        last = (q == q[-1]) & (c == c[-1])
        cut = int(np.argmax(last))  # the last group may continue in the next batch
        carry = pdf.iloc[cut:]
        done = pdf.iloc[:cut]
        if len(done):
            yield _score_frame(done)
    if carry is not None and len(carry):
        yield _score_frame(carry)


def _score_frame(pdf):
    q, c = pdf["query_id"].to_numpy(), pdf["chunk_id"].to_numpy()
    starts, ok, score = _covers_sorted(q, c, pdf["pos"].to_numpy(dtype=np.int64), pdf["li"].to_numpy(dtype=np.int64),
                                       pdf["n_lex"].to_numpy(dtype=np.int64))
    return pd.DataFrame({"query_id": q[starts][ok], "chunk_id": c[starts][ok], "score": score[ok]})


def cover_density_sorted(occ: DataFrame, partitions: int | None = None) -> DataFrame:
    """F4 + F5: occurrences hash-partitioned by (query, chunk), sorted by position within
    partitions (Tungsten sort, spills), scored group by group in numpy batches."""
    n = partitions or int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    srt = occ.repartition(n, "query_id", "chunk_id").sortWithinPartitions("query_id", "chunk_id", "pos")
    out = srt.mapInPandas(_cover_density_batches, "query_id long, chunk_id long, score double")
    return out.select("query_id", "chunk_id", round_half_up("score", RANK_DIGITS).alias("rank_bm25"))


# ------------------------------------------------------------------ many queries at once, in bounded memory

SLICE_TOKENS = 1 << 18  # tokens of chunks that a task looks at together
EXPANDED = 1 << 19  # pairs or occurrences that a task expands at once


def lexeme_sets(qlex: DataFrame) -> DataFrame:
    """Queries by what they ask: ``(query_id, set_id, toks, rep)``, a table in the shared folder.

    Matches and ranks depend on a query's set of lexemes alone, so a set is scored once, under the least id of
    its queries. ``rep`` is how often the query's rows repeat; ids whose rows aren't one query's have no set."""
    per = qlex.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(
        F.array_sort(F.collect_set("tok")).alias("toks"), F.count(F.lit(1)).alias("n"), F.max("n_lex").alias("n_lex"))
    per = per.where("size(toks) = n_lex and n % n_lex = 0").select("query_id", "toks", F.expr("int(n div n_lex)").alias("rep"))
    least = F.min("query_id").over(Window.partitionBy("toks", "rep"))
    return sizing.materialize(per.select("query_id", least.alias("set_id"), "toks", "rep"))


def members(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of sets as rows of all their queries."""
    of = sets.select("set_id", "query_id")
    of = F.broadcast(of) if sizing.fits_broadcast(of, row_bytes=64) else of
    cols = ["query_id", *(c for c in found.columns if c != "set_id")]
    return found.join(of, "set_id").select(*cols)


class SetTable:
    """The distinct sets as arrays: a set's lexemes are ``lex[start[i]:start[i] + n[i]]``, codes of ``vocab``."""

    def __init__(self, sets: DataFrame):
        rows = sets.where("set_id = query_id").select("set_id", "toks", "rep").toPandas()
        toks = rows["toks"].to_list()
        self.set_id, self.rep = rows["set_id"].to_numpy(dtype=np.int64), rows["rep"].to_numpy(dtype=np.int64)
        self.n = np.array([len(t) for t in toks], dtype=np.int64)
        self.start = np.cumsum(self.n) - self.n
        flat = np.concatenate([np.asarray(t, dtype=object) for t in toks]) if toks else np.array([], dtype=object)
        self.lex, words = pd.factorize(flat)
        self.lex, self.vocab = self.lex.astype(np.int64), pd.Index(words, dtype=object)


def _ranges(start, n):
    """All numbers of the ranges ``start[i] .. start[i] + n[i] - 1``, one after another."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()), dtype=np.int64)


def score_sets(table: SetTable, chunk, lex, pos, only=None):
    """Matches of the sets (or of those numbered ``only``) in the occurrences of some chunks, as arrays (set number, chunk,
    score), in parts. At most ``EXPANDED`` pairs or occurrences are expanded at once, or those of a set or pair alone."""
    if len(pos) == 0 or len(table.set_id) == 0:
        return
    ids, chunk = np.unique(chunk, return_inverse=True)
    codes, lex = np.unique(lex, return_inverse=True)
    order = np.lexsort((pos, lex, chunk))
    chunk, lex, pos = chunk[order].astype(np.int64), lex[order].astype(np.int64), pos[order]
    width = len(codes)
    cell = chunk * width + lex
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    cell, count = cell[first], np.diff(np.r_[first, len(pos)])
    # the chunks of each lexeme
    by_lex = np.argsort(cell % width, kind="stable")
    df = np.bincount(cell % width, minlength=width)
    held = np.cumsum(df) - df
    # sets whose lexemes are all here, by their rarest
    sets = np.arange(len(table.n)) if only is None else np.unique(only)
    rows = _ranges(table.start[sets], table.n[sets])
    of = np.repeat(np.arange(len(sets)), table.n[sets])
    at = np.minimum(np.searchsorted(codes, table.lex[rows]), width - 1)
    here = codes[at] == table.lex[rows]
    whole = np.bincount(of[here], minlength=len(sets)) == table.n[sets]
    rows, of, at = rows[whole[of]], of[whole[of]], at[whole[of]]
    if len(of) == 0:
        return
    key = np.lexsort((df[at], of))
    key = key[np.r_[True, of[key][1:] != of[key][:-1]]]
    lead, sets = at[key], sets[whole]
    n, start = table.n[sets], np.cumsum(table.n[sets]) - table.n[sets]
    for i, j in sizing.pieces(df[lead], EXPANDED):
        s = np.repeat(np.arange(i, j), df[lead[i:j]])
        c = cell[by_lex[_ranges(held[lead[i:j]], df[lead[i:j]])]] // width
        total = np.zeros(len(s), dtype=np.int64)
        for li in range(int(n[i:j].max())):  # pairs that hold every lexeme, and their occurrences
            asks = li < n[s]
            want = c * width + at[np.where(asks, start[s] + li, 0)]
            found = np.minimum(np.searchsorted(cell, want), len(cell) - 1)
            has = cell[found] == want
            total += np.where(asks & has, count[found], 0)
            keep = has | ~asks
            s, c, total = s[keep], c[keep], total[keep]
        for a, b in sizing.pieces(total * table.rep[sets[s]], EXPANDED):
            ps, pc, parts = s[a:b], c[a:b], []
            for li in range(int(n[ps].max())):
                who = np.flatnonzero(li < n[ps])
                found = np.searchsorted(cell, pc[who] * width + at[start[ps[who]] + li])
                occ = _ranges(first[found], count[found])
                pair = np.repeat(who, count[found])
                again = table.rep[sets[ps[pair]]]
                pair, occ = np.repeat(pair, again), np.repeat(occ, again)
                parts.append((pair, pos[occ], np.full(len(occ), li, dtype=np.int64)))
            pair, where, which = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((where, pair))
            pair, where, which = pair[order], where[order].astype(np.int64), which[order]
            _, ok, score = _covers_sorted(pair, pair, where, which, n[ps[pair]])
            yield sets[ps][ok], ids[pc][ok], score[ok]


def _rounded(score):
    """As ``round_half_up`` to ``RANK_DIGITS``."""
    return np.floor(score * 10.0 ** RANK_DIGITS + 0.5) / 10.0 ** RANK_DIGITS


def best_of_task(parts, k: int | None, most: int = 1 << 20):
    """A task's matches, cut to each set's ``k`` best (rank desc, chunk asc), which is exact for any cut that follows.
    What it holds is bounded: rows that stay too many go out and it begins anew."""
    if k is None:
        yield from parts
        return
    held, size = [], 0

    def cut():
        s, c, r = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((c, -_rounded(r), s))
        s, c, r = s[order], c[order], r[order]
        begins = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        place = np.arange(len(s)) - np.repeat(begins, np.diff(np.r_[begins, len(s)]))
        return s[place < k], c[place < k], r[place < k]

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > most:
            held = [cut()]
            size = len(held[0][0])
            if size > most // 2:
                yield held[0]
                held, size = [], 0
    if size:
        yield cut()


def _scan_chunks(bc):
    """Chunk batches to matches: slices of whole chunks, their tokens as codes of the queries' lexemes (minus the stop
    words of the chunk's configuration), scored by set."""

    def occurrences(batch, table, stops):
        ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
        toks = batch.column("toks")
        order = np.argsort(ids, kind="stable")  # rows that repeat an id in a batch are one chunk
        ids = ids[order]
        lens = pc.list_value_length(toks).to_numpy(zero_copy_only=False)[order].astype(np.int64)
        begins = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        for i, j in sizing.pieces(np.add.reduceat(lens, begins), SLICE_TOKENS):
            a, b = begins[i], begins[j] if j < len(begins) else len(ids)
            words = toks.take(pa.array(order[a:b])).flatten().dictionary_encode()
            if len(words) == 0:
                continue
            code = table.vocab.get_indexer(words.dictionary.to_pandas())[words.indices.to_numpy()]
            row = np.repeat(np.arange(a, b), lens[a:b])
            pos = _ranges(np.ones(b - a, dtype=np.int64), lens[a:b])
            keep = code >= 0
            if stops is not None:
                names = np.asarray(batch.column("config").take(pa.array(order[a:b])).to_pylist(), dtype=object)[row - a]
                for name in {x for x in names if x in stops}:
                    keep &= ~((names == name) & np.isin(code, stops[name]))
            yield ids[row[keep]], code[keep].astype(np.int64), pos[keep]

    def fn(batches):
        table, stops, k = bc.value

        def parts():
            for batch in batches:
                if batch.num_rows:
                    for chunk, code, pos in occurrences(batch, table, stops):
                        yield from score_sets(table, chunk, code, pos)

        for s, c, r in best_of_task(parts(), k):
            yield pa.RecordBatch.from_arrays([pa.array(table.set_id[s]), pa.array(c), pa.array(r)], ["set_id", "chunk_id", "score"])

    return fn


def lexical_scan(chunks: DataFrame, qlex: DataFrame, config_col: str | None = None,
                 fold_accents: bool = True, k: int | None = None) -> DataFrame:
    """F4 + F5 without moving postings: the (size-checked) query lexemes are broadcast and
    every chunk partition is scored where it is read. Output: matches only, or with ``k`` the best of each query, ranked."""
    from ragloom.operators import stopwords

    sets = lexeme_sets(qlex)
    table = SetTable(sets.where("rep = 1"))
    stops = None
    if config_col:
        codes = {c: table.vocab.get_indexer(list(ws)) for c, ws in stopwords.word_lists().items()}
        stops = {c: x[x >= 0] for c, x in codes.items()}
    bc = chunks.sparkSession.sparkContext.broadcast((table, stops, k))
    cols = [F.col("chunk_id").cast("long").alias("chunk_id"), T.tokens("content", fold_accents=fold_accents).alias("toks")]
    if config_col:
        cols.append(F.col(config_col).alias("config"))
    texts = chunks.where("content is not null and chunk_id is not null").select(*cols)
    out = texts.mapInArrow(_scan_chunks(bc), "set_id long, chunk_id long, score double")
    out = out.select("set_id", "chunk_id", round_half_up("score", RANK_DIGITS).alias("rank_bm25"))
    return members(out if k is None else top_k(out, k, "rank_bm25", part="set_id"), sets)


def query_lexemes_config(queries: DataFrame, text_col: str = "query_text", config_col: str = "config",
                         stems: DataFrame | None = None) -> DataFrame:
    """F3 + F7: query lexemes with the stop words of the query's own configuration removed, and replaced by
    their ``stems``, if given: a table that holds the queries' tokens too."""
    from ragloom.operators import stopwords

    toks = queries.select("query_id", F.col(config_col).alias("config"),
                          F.posexplode(T.tokens(T.py_strip(text_col), fold_accents=False)).alias("p", "tok"))
    sw = F.broadcast(stopwords.stop_table(queries.sparkSession))  # fixed dictionary, a few thousand words
    kept = toks.join(sw, ["config", "tok"], "left_anti")
    if stems is not None:
        from ragloom.operators import stemming

        kept = stemming.apply(kept, stems)
    lex = kept.groupBy("query_id").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("p", "tok"))), lambda x: x["tok"]))
        .alias("lex"))
    return lex.select("query_id", F.size("lex").alias("n_lex"), F.posexplode("lex").alias("li", "tok"))


def lexical_match(chunks: DataFrame, queries: DataFrame, k: int | None = None, **kw) -> DataFrame:
    """``(query_id, chunk_id, rank_bm25)`` for every chunk holding all query lexemes; with ``k`` only the
    query's best, with their ``rank``.

    With ``config_col`` (on chunks) and ``query_config_col`` (on queries), stop words
    are removed per text search configuration on both sides (F7 routing).
    """
    config = kw.get("config_col")
    qlex = query_lexemes_config(queries, config_col=kw["query_config_col"]) if config else query_lexemes(queries)
    if kw.get("stop_words") is None and sizing.fits_broadcast(qlex, row_bytes=64, limit=kw.get("broadcast_limit_bytes")):
        return lexical_scan(chunks, qlex, config_col=config, fold_accents=kw.get("fold_accents", True), k=k)
    # lexemes too many to broadcast: candidates by each query's rarest lexeme, kept if the chunk has all
    # of them, and only then the positions, scored per (query, chunk) after a sort within partitions
    fold = kw.get("fold_accents", True)
    if config:
        from ragloom.operators import stopwords

        post = stopwords.config_postings(chunks, config_col=config, fold_accents=fold)
    else:
        post = postings(chunks, fold_accents=fold, stop_words=kw.get("stop_words"))
    qlex = sizing.materialize(qlex)
    asked = sizing.materialize(post.join(qlex.select("tok").distinct(), "tok", "left_semi"))
    terms = asked.select("chunk_id", "tok").distinct()
    found = terms.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    rarest = qlex.join(found, "tok").groupBy("query_id").agg(F.min(F.struct("df", "tok")).alias("k"), F.count(F.lit(1)).alias("n"), F.max("n_lex").alias("n_lex"))
    cand = rarest.where("n = n_lex").select("query_id", F.col("k.tok").alias("tok")).join(terms, "tok").select("query_id", "chunk_id")
    whole = cand.join(qlex, "query_id").join(terms, ["chunk_id", "tok"]).groupBy("query_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_lex").alias("n_lex")).where("n = n_lex").select("query_id", "chunk_id")
    occ = whole.join(qlex, "query_id").join(asked, ["chunk_id", "tok"])
    found = cover_density_sorted(occ.select("query_id", "chunk_id", "pos", "li", "n_lex"))
    return found if k is None else top_k(found, k, "rank_bm25")


def top_k(df: DataFrame, k: int, score: str, part: str = "query_id", tie: str = "chunk_id",
          rank_col: str = "rank") -> DataFrame:
    """Best ``k`` rows per ``part`` by ``score`` desc, ties by ``tie`` asc; ``rank`` 1..k."""
    w = Window.partitionBy(part).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k).withColumn(
        rank_col, F.col(rank_col).cast("long"))


def lexical_topk(chunks: DataFrame, queries: DataFrame, k: int = C.LEXICAL_CANDIDATES, **kw) -> DataFrame:
    """the ``k`` best cover-density matches per query (rank desc, chunk_id asc)."""
    return lexical_match(chunks, queries, k, **kw)
