"""Structured Streaming: savings in event-time windows, job states that speak only when they change, chunked requests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_BODY = 64 << 20
ROWS = 10_000  # of a frame that goes back


def windowed_savings(records: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Savings by event-time window and command type; ``records`` has ts, command_type, raw_tokens, compressed_tokens."""
    saved = F.greatest(F.col("raw_tokens") - F.col("compressed_tokens"), F.lit(0))
    out = records.withWatermark("ts", late).groupBy(F.window("ts", window), "command_type").agg(F.sum(saved).alias("tokens_saved"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "command_type", "tokens_saved", "n")


def job_transitions(lines: DataFrame) -> DataFrame:
    """job, seq, status of a watched run (job, seq, status): a row when a job's status is new or error text appears.

    Spark may cut a job's lines into several batches in any order, so they are put in order together: a task holds 12 bytes for each
    line that a job has in one micro-batch, and each distinct status once.
    """

    def step(key, batches, state: GroupState):
        names: list = []  # by code
        codes: dict = {}
        seqs, found = [], []
        if state.exists:
            codes[state.get[0]] = 0
            names.append(state.get[0])
        for pdf in batches:
            at = np.empty(len(pdf), np.int32)
            for i, status in enumerate(pdf.status):
                code = codes.get(status)
                if code is None:
                    code = codes[status] = len(names)
                    names.append(status)
                at[i] = code
            seqs.append(pdf.seq.to_numpy(np.int64))
            found.append(at)
        seq, code = np.concatenate(seqs), np.concatenate(found)
        rank = np.empty(len(names), np.int32)  # equal numbers by status
        rank[sorted(range(len(names)), key=lambda i: str(names[i]))] = np.arange(len(names), dtype=np.int32)
        order = np.lexsort((rank[code], seq))
        seq, code = seq[order], code[order]
        error = np.array([str(n).lower().startswith("error:") for n in names], bool)[code]
        own = code[~error]
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        if state.exists and len(own):
            new[0] = own[0] != 0
        kept = error.copy()
        kept[~error] = new
        if len(own):
            state.update((names[own[-1]],))
        seq, code = seq[kept], code[kept]
        for i in range(0, len(seq), ROWS):
            yield pd.DataFrame({"job": key[0], "seq": seq[i : i + ROWS], "status": [names[c] for c in code[i : i + ROWS]]})

    return lines.groupBy("job").applyInPandasWithState(step, "job string, seq bigint, status string", "last string", "append", GroupStateTimeout.NoTimeout)


def assemble_chunks(chunks: DataFrame, most: int = MAX_BODY) -> DataFrame:
    """request_id, body, n_bytes, accepted of chunks (request_id, chunk_no, data): in order; too large ones are refused unread."""
    size = chunks.groupBy("request_id").agg(F.sum(F.octet_length("data")).alias("n_bytes"))
    small = chunks.join(size.filter(F.col("n_bytes") <= most).select("request_id"), "request_id", "left_semi")
    body = small.groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "data"))), lambda x: x["data"]), "").alias("body"))
    return size.join(body, "request_id", "left").select("request_id", "body", "n_bytes", (F.col("n_bytes") <= most).alias("accepted"))
