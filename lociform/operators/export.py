"""Alignment rows back to SAM records: CIGAR and MD from segments and variations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strings_of(segments: list[dict]) -> tuple[str, str]:
    """(CIGAR, MD) of a read's segments in order; variations as ``variants.parse_alignment`` gives them."""
    ops: list[list] = []
    md: list[str] = []
    run = 0

    def add(op: str, n: int) -> None:
        if n and ops and ops[-1][1] == op:
            ops[-1][0] += n
        elif n:
            ops.append([n, op])

    for k, seg in enumerate(segments):
        if k:
            before = segments[k - 1]
            add("N", seg["position"] - before["position"] - before["target_aligned_length"])
        add("S", len(seg["left_clip"] or ""))
        done = 0
        for v in sorted(seg["variations"], key=lambda v: (v["position"], v["read_index"])):
            gap, given = v["from"].count("-"), v["to"].count("-")
            upto = v["position"] if gap else v["position"] - 1
            add("M", upto - done)
            run += upto - done
            done = upto
            if gap:
                add("I", gap)
            elif given:
                add("D", given)
                md += [str(run), "^" + v["from"]]
                run, done = 0, done + given
            else:
                n = len(v["from"])
                add("M", n)
                for base in v["from"]:
                    md += [str(run), base]
                    run = 0
                done += n
        add("M", seg["target_aligned_length"] - done)
        run += seg["target_aligned_length"] - done
        add("S", len(seg["right_clip"] or ""))
    return "".join(f"{n}{op}" for n, op in ops), "".join([*md, str(run)])


def sam_records(aligned: DataFrame) -> DataFrame:
    """(qname, flag, rname, pos, mapq, cigar, md, n_segments) of alignment rows, one for each read and mate."""
    names = ["fragment_index", "position", "target_aligned_length", "left_clip", "right_clip", "variations"]
    reads = aligned.groupBy("qname", F.col("pair_flags").alias("flag"), F.col("target").alias("rname")).agg(F.max("mapping_quality").alias("mapq"), F.array_sort(F.collect_list(F.struct(*names))).alias("segments"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [strings_of([dict(s) if isinstance(s, dict) else s.asDict(True) for s in x]) for x in b["segments"]]
            b["pos"] = [int(x[0]["position"]) + 1 for x in b["segments"]]
            b["cigar"], b["md"], b["n_segments"] = [g[0] for g in got], [g[1] for g in got], [len(x) for x in b["segments"]]
            yield b[["qname", "flag", "rname", "pos", "mapq", "cigar", "md", "n_segments"]]

    return reads.mapInPandas(run, "qname string, flag int, rname string, pos int, mapq int, cigar string, md string, n_segments int")
