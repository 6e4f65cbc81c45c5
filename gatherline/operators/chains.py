"""State sequences: the likeliest path over long ordered streams.

It is a product of K x K matrices along a sequence, so a long sequence is cut into
blocks: (1) each block gives its transfer matrix, (2) a small pass over the blocks of
a sequence gives what enters and leaves each block, (3) each block is finished on its
own. A hot sequence is spread over as many tasks as it has blocks, with exact results.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatherline.operators.ordered import join_on, ordered_scan, row_no, settle

BLOCK_ROWS = 100_000
_CELLS = 1 << 20


def _transfer(e, log_a, first, plus):
    """Score of every (state before the block, last state) pair; the first block ignores its row."""
    k = e.shape[1]
    v = np.tile(first + e[0], (k, 1)) if first is not None else log_a + e[0][None, :]
    for t in range(1, len(e)):
        v = plus(v[:, :, None] + log_a[None, :, :], 1) + e[t][None, :]
    return v


def _max(a, axis):
    return np.max(a, axis=axis)


def _key_schema(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _with_chain_blocks(df: DataFrame, keys: Sequence[str], order: Sequence, block_rows: int | None) -> DataFrame:
    block_rows = block_rows or BLOCK_ROWS
    d = ordered_scan(df, keys, order, {"_pos": row_no()})
    return d.withColumn("_block", F.floor((F.col("_pos") - 1) / block_rows))


def _head(pdf: pd.DataFrame, keys: Sequence[str]) -> dict:
    return {k: [pdf[k].iloc[0]] for k in keys}


def viterbi_smooth(df: DataFrame, keys: Sequence[str], order: Sequence, log_probs: str, penalty: float, out: str = "state",
                   block_rows: int | None = None) -> DataFrame:
    """Most likely state path when every switch of state costs ``penalty``.

    ``log_probs`` is an array column with one score per state.
    """
    keys = list(keys)
    d = _with_chain_blocks(df, keys, order, block_rows)
    lean = d.select(*keys, "_pos", "_block", F.col(log_probs).alias("_lp"))
    emit = lambda pdf: np.vstack(pdf["_lp"].to_numpy()).astype(float)
    done = _best_path(lean, keys, emit, lambda k: np.where(np.eye(k, dtype=bool), 0.0, -float(penalty)), np.zeros)
    return join_on(d, done, [*keys, "_block", "_pos"], "inner").withColumnRenamed("_state", out).drop("_pos", "_block")


def _short_paths(batches, keys: list[str], names: list[str], emit, trans, start):
    """The likeliest paths of whole sequences, many side by side, one time step after the other."""
    for batch in batches:
        n = np.asarray(pc.list_value_length(batch.column("_r"))).astype(int)
        rows = batch.column("_r").flatten()
        e = emit(pd.DataFrame({c: rows.field(c).to_pandas() for c in names}))
        k = e.shape[1]
        a, at, by = trans(k), np.concatenate(([0], np.cumsum(n))), np.argsort(-n, kind="stable")
        states, lo = np.zeros(len(e), np.int64), 0
        while lo < len(by):
            most = int(n[by[lo]])
            some = by[lo : lo + max(1, _CELLS // (most * k * k))]
            lo += len(some)
            live = np.searchsorted(-n[some], -np.arange(most), side="left").tolist()
            back, end = np.zeros((most, len(some), k), np.int32), np.zeros((len(some), k))
            for t, m in enumerate(live):
                now = e[at[some[:m]] + t]
                if t:
                    w = v[:m, :, None] + a
                    back[t, :m] = w.argmax(1)
                    v = w.max(1) + now
                else:
                    v = now + start(k)
                end[:m] = v
            state = end.argmax(1)
            for t in range(most - 1, -1, -1):
                m, on = live[t], live[t + 1] if t + 1 < most else 0
                if on:
                    state[:on] = back[t + 1, np.arange(on), state[:on]]
                states[at[some[:m]] + t] = state[:m]
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(states))
        places = pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows.field("_pos"))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], places, lists], [*keys, "_pos", "_state"])


def _best_path(lean: DataFrame, keys: list[str], emit, trans, start) -> DataFrame:
    """(keys, _block, _pos, _state) of the likeliest path; ``trans`` and ``start`` give log scores for a number of states.

    Sequences of one block are packed and done in one pass, many side by side; only longer ones go block by block."""
    names = [c for c in lean.columns if c not in (*keys, "_block", "_pos")]
    rows = lean.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct("_pos", *names))).alias("_r"))
    whole = settle(rows.withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    ks = ", ".join(f"`{c}` {lean.schema[c].dataType.simpleString()}" for c in keys)
    done = whole.where("_blocks = 1").select(*keys, "_r").mapInArrow(lambda b: _short_paths(b, keys, names, emit, trans, start), f"{ks}, _pos array<long>, _state array<long>")
    done = done.select(*keys, F.lit(0).cast("long").alias("_block"), F.inline(F.arrays_zip("_pos", "_state")))
    many = whole.where("_blocks > 1")
    if many.isEmpty():
        return done
    return done.unionByName(_long_paths(many.select(*keys, "_block", F.inline("_r")), keys, emit, trans, start))


def _long_paths(lean: DataFrame, keys: list[str], emit, trans, start) -> DataFrame:
    """The same for sequences of several blocks."""

    def mats(pdf):
        pdf = pdf.sort_values("_pos")
        e, b = emit(pdf), int(pdf["_block"].iloc[0])
        m = _transfer(e, trans(e.shape[1]), start(e.shape[1]) if b == 0 else None, _max)
        return pd.DataFrame({**_head(pdf, keys), "_block": [b], "_m": [m.ravel().tolist()]})

    ks = _key_schema(lean, keys)
    m_schema = T.StructType([*ks, T.StructField("_block", T.LongType()), T.StructField("_m", T.ArrayType(T.DoubleType()))])
    m = lean.groupBy(*keys, "_block").applyInPandas(mats, m_schema)

    def borders(pdf):
        pdf = pdf.sort_values("_block")
        k = int(round(len(pdf["_m"].iloc[0]) ** 0.5))
        ms = [np.asarray(x, dtype=float).reshape(k, k) for x in pdf["_m"]]
        f = [ms[0][0]]
        for x in ms[1:]:
            f.append(np.max(f[-1][:, None] + x, axis=0))
        outs = [int(np.argmax(f[-1]))]
        for b in range(len(ms) - 1, 0, -1):
            outs.append(int(np.argmax(f[b - 1] + ms[b][:, outs[-1]])))
        outs = outs[::-1]
        return pd.DataFrame({**{c: pdf[c].to_numpy() for c in keys}, "_block": pdf["_block"].to_numpy(), "_in": [-1, *outs[:-1]], "_out": outs})

    b_schema = T.StructType([*ks, T.StructField("_block", T.LongType()), T.StructField("_in", T.IntegerType()), T.StructField("_out", T.IntegerType())])
    b = m.groupBy(*keys).applyInPandas(borders, b_schema)

    def finish(pdf):
        pdf = pdf.sort_values("_pos")
        e = emit(pdf)
        a = trans(e.shape[1])
        s_in, s_out = int(pdf["_in"].iloc[0]), int(pdf["_out"].iloc[0])
        v = e[0] + (a[s_in] if s_in >= 0 else start(e.shape[1]))
        back = np.zeros(e.shape, dtype=int)
        for t in range(1, len(e)):
            w = v[:, None] + a
            back[t] = np.argmax(w, axis=0)
            v = w[back[t], np.arange(len(v))] + e[t]
        path = np.empty(len(e), dtype=int)
        path[-1] = s_out
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t][path[t]]
        return pd.DataFrame({**{c: pdf[c].to_numpy() for c in keys}, "_block": pdf["_block"].to_numpy(), "_pos": pdf["_pos"].to_numpy(), "_state": path})

    f_schema = T.StructType([*ks, *[T.StructField(c, T.LongType()) for c in ("_block", "_pos", "_state")]])
    return join_on(lean, b, [*keys, "_block"], "inner").groupBy(*keys, "_block").applyInPandas(finish, f_schema)
