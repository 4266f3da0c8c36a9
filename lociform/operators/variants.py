"""Alignment strings to variations, equivalent indels, indel alleles and realignment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.scratch import stored

CIGAR = re.compile(r"([0-9]+)([MIDNSHP=X])")
MD = re.compile(r"([0-9]+)|\^([A-Z]+)|([A-Z])")


def parse_alignment(pos: int, cigar: str, md: str | None, seq: str) -> list[dict]:
    """Segments of a SAM row, split at introns: position (0-based), aligned lengths, clips, variations.

    A variation is (from, to, position in the segment's reference from 1, read index from 1);
    reference bases come from MD and are N without it.
    """
    ref_ops: list[tuple[str, str]] = []
    for n, deleted, base in MD.findall(md or ""):
        ref_ops += [("=", "")] * int(n) if n else [("D", b) for b in deleted] if deleted else [("X", base)]
    at_ref = 0
    ops = [(int(n), op) for n, op in CIGAR.findall(cigar)]
    read, start, segments = 0, pos - 1, []
    seg = {"position": start, "target_length": 0, "query_length": 0, "left_clip": "", "right_clip": "", "variations": []}
    for k, (n, op) in enumerate(ops):
        if op == "S":
            if any(o in "M=XIDN" for _, o in ops[:k]):
                seg["right_clip"] = seq[read : read + n]
            else:
                seg["left_clip"] = seq[read : read + n]
            read += n
        elif op in "M=X":
            for i in range(n):
                kind, base = ref_ops[at_ref] if at_ref < len(ref_ops) else ("=", "")
                at_ref += bool(ref_ops)
                if kind == "X" or (not ref_ops and op == "X"):
                    seg["variations"].append((base or "N", seq[read + i : read + i + 1], seg["target_length"] + i + 1, read + i + 1))
            seg["target_length"] += n
            seg["query_length"] += n
            read += n
        elif op == "I":
            seg["variations"].append(("-" * n, seq[read : read + n], seg["target_length"], read + 1))
            seg["query_length"] += n
            read += n
        elif op == "D":
            gone = "".join(b for _, b in ref_ops[at_ref : at_ref + n]) or "N" * n
            at_ref += n if ref_ops else 0
            seg["variations"].append((gone, "-" * n, seg["target_length"] + 1, read))
            seg["target_length"] += n
        elif op == "N":
            segments.append(seg)
            seg = {"position": seg["position"] + seg["target_length"] + n, "target_length": 0, "query_length": 0, "left_clip": "", "right_clip": "", "variations": []}
    return [*segments, seg]


ROWS = "qname string, fragment_index int, target string, position bigint, reverse boolean, pair_flags int, mapping_quality int, ambiguity int, target_aligned_length int, query_aligned_length int, left_clip string, right_clip string, spliced boolean, variations array<struct<from:string,to:string,position:int,read_index:int>>"


#: The columns of ``ROWS`` but the last one, and the fields of that.
PLAIN = dict(zip("qname fragment_index target position reverse pair_flags mapping_quality ambiguity target_aligned_length query_aligned_length left_clip right_clip spliced".split(), [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), *[pa.int32()] * 5, pa.string(), pa.string(), pa.bool_()], strict=True))
VARIATION = {"from": pa.string(), "to": pa.string(), "position": pa.int32(), "read_index": pa.int32()}


class _Cuts:
    """Stands for a read: what is cut out of it is the place of the cut."""

    def __getitem__(self, at: slice) -> slice:
        return at


@lru_cache(1 << 14)
def _template(cigar: str, md: str | None) -> list[tuple]:
    """``parse_alignment`` of any read at position 0, as most records share few pairs of strings."""
    segs = parse_alignment(1, cigar, md, _Cuts())
    return [(s["position"], s["target_length"], s["query_length"], s["left_clip"], s["right_clip"], s["variations"]) for s in segs]


def alignments(sam: DataFrame) -> DataFrame:
    """Alignment rows of mapped SAM records (S7, S8): one for each segment between introns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            seen: list[tuple] = []
            ends = [0]
            for qname, flag, rname, pos, mapq, cigar, seq, md, nh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segs = _template(cigar, md)
                cut = seq or ""
                more, ambiguity, spliced = bool(flag & 16), int(nh) if nh else 1, len(segs) > 1
                for i, (at, target, query, left, right, variations) in enumerate(segs):
                    out.append((qname, i, rname, None if pos is None else pos - 1 + at, more, flag, mapq, ambiguity, target, query, cut[left] if left else "", cut[right] if right else "", spliced))
                    seen += [(f, cut[to] if isinstance(to, slice) else to, p, r) for f, to, p, r in variations]
                    ends.append(len(seen))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * len(PLAIN), PLAIN.values(), strict=True)]
            parts = [pa.array(x, t) for x, t in zip(zip(*seen, strict=True) if seen else [()] * len(VARIATION), VARIATION.values(), strict=True)]
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=list(VARIATION))))
            yield pa.RecordBatch.from_arrays(columns, names=[*PLAIN, "variations"])

    tags = F.col("tags")
    mapped = sam.where("(flag & 4) = 0 AND cigar != '*'").select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", tags["MD"].alias("md"), tags["NH"].alias("nh"))
    return mapped.mapInArrow(run, ROWS)


def variation_rows(aligned: DataFrame) -> DataFrame:
    """One row for each variation, with its kind and place on the reference from 1."""
    v = aligned.select("qname", "target", "position", "reverse", "query_aligned_length", F.explode("variations").alias("v"))
    kind = F.when(F.col("v.from").contains("-"), "READ_INSERTION").when(F.col("v.to").contains("-"), "READ_DELETION").otherwise("MUTATION")
    return v.select("qname", "target", (F.col("position") + F.col("v.position")).alias("position_on_reference"), F.col("v.read_index").alias("read_index"), F.col("v.from").alias("var_from"), F.col("v.to").alias("var_to"), kind.alias("type"))


def splice_events(aligned: DataFrame, least_quality: int = 0) -> DataFrame:
    """(target, first, last, reverse, n) of introns between consecutive segments."""
    from pyspark.sql import Window

    w = Window.partitionBy("qname", "target", "pair_flags").orderBy("fragment_index")
    own = aligned.where(F.col("spliced") & (F.col("mapping_quality") >= least_quality))
    own = own.withColumn("next", F.lead("position").over(w)).where("next IS NOT NULL")
    return own.groupBy("target", (F.col("position") + F.col("target_aligned_length")).alias("first"), (F.col("next") - 1).alias("last"), "reverse").agg(F.count("*").alias("n"))


def equivalent_indel(genome: str, start: int, deleted: str, inserted: str, flank: int = 4) -> dict | None:
    """The widest placement of an indel and its flanks.

    ``start``: 0-based place before which the indel stands. The bounds move left while the
    base before equals the indel's last base, cyclically, and right likewise.
    """
    p = deleted or inserted
    if not p or start > len(genome) or start < 0:
        return None
    lo, hi = start, start + len(deleted)
    k = 0
    while lo > 0 and genome[lo - 1] == p[-1 - k % len(p)]:
        lo, k = lo - 1, k + 1
    j = 0
    while hi < len(genome) and genome[hi] == p[j % len(p)]:
        hi, j = hi + 1, j + 1
    span = genome[lo:hi]
    if deleted:
        source, target = span, "-" * len(p) + span[len(p) :]
    else:
        turn = k % len(p)
        source, target = "-" * len(p) + span, p[len(p) - turn :] + p[: len(p) - turn] + span
    return {"start": lo, "end": hi, "from": source, "to": target, "flank_left": genome[max(0, lo - flank) : lo], "flank_right": genome[hi : hi + flank]}


def equivalent_indels(indels: DataFrame, flank: int = 4) -> DataFrame:
    """``indels`` (target, start, deleted, inserted, genome, offset) with their canonical placement.

    ``genome`` is the stretch of the reference around the indel that begins at ``offset``.
    """
    extra = "eir_start bigint, eir_end bigint, eir_from string, eir_to string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [equivalent_indel(g, s - o, d or "", i or "", flank) for g, s, o, d, i in zip(b["genome"], b["start"], b["offset"], b["deleted"], b["inserted"], strict=True)]
            b["eir_start"] = pd.array([None if x is None else x["start"] + o for x, o in zip(got, b["offset"], strict=True)], "Int64")
            b["eir_end"] = pd.array([None if x is None else x["end"] + o for x, o in zip(got, b["offset"], strict=True)], "Int64")
            b["eir_from"] = [None if x is None else x["from"] for x in got]
            b["eir_to"] = [None if x is None else x["to"] for x in got]
            yield b

    kinds = ", ".join(f"`{n}` {t}" for n, t in indels.dtypes)
    return indels.mapInPandas(run, f"{kinds}, {extra}")


def vcf_indel(source: str, targets: list[str]) -> tuple[str, list[str]]:
    """REF and ALTs of gapped alleles (C16): one-base alternates padded, the shared tail cut, gaps removed."""
    alts = [t + source[1:] if len(t) == 1 and len(source) > 1 else t for t in targets]
    last_gap = max([i for a in (source, *alts) for i, c in enumerate(a) if c == "-"], default=-1)
    cut = 0
    while len(source) - cut > max(last_gap + 1, 1) and all(len(a) - cut > 1 and a[-1 - cut] == source[-1 - cut] for a in alts):
        cut += 1
    clean = lambda a: a[: len(a) - cut if cut else None].replace("-", "")
    return clean(source), [clean(a) for a in alts]


def merge_from(alleles: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """Alternates of several reference strings of one place re-expressed on the longest."""
    plain = [(f.replace("-", ""), t.replace("-", "")) for f, t in alleles]
    longest = max((f for f, _ in plain), key=len)
    return longest, [t + longest[len(f) :] if longest.startswith(f) else t for f, t in plain]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def realign_score(read: str | np.ndarray, genome: str | np.ndarray, start: int, at: int, length: int, deletion: bool) -> int:
    """Matches gained by shifting a read's tail over an indel at ``at`` (W18): +1 for a mismatch explained, -1 for a new one, -20 outside."""
    read, genome = (_codes(x) if isinstance(x, str) else x for x in (read, genome))
    shift = length if deletion else -length
    first = max(0, (at if deletion else max(at, at + length)) - start)
    if first >= len(read):
        return 0
    end = min(len(read), len(genome) - start - max(shift, 0))
    if start + first + min(shift, 0) < 0 or end <= first:
        return -20
    before, after = (np.count_nonzero(read[first:end] == genome[start + s + first : start + s + end]) for s in (0, shift))
    return int(after) - int(before) - (20 if end < len(read) else 0)


def realigned(reads: DataFrame, indels: DataFrame, genome: DataFrame, size: int, reach: int = 100) -> DataFrame:
    """reads (target, start, end, seq, score) with the best positive indel shift near them.

    ``genome``: blocks (target, block, bases) of ``size`` bases. A range join brings each read
    its candidate indels, and a join by block the stretch of the reference around it, so no
    task holds a whole sequence. Bases travel once for each read, not for each of its blocks
    or candidates. Reads with nulls and repeated reads are kept as they are; a read without
    a gain has a null shift.
    """
    from lociform.operators.intervals import overlap_join

    own = stored(reads.withColumn("__id", F.monotonically_increasing_id()))
    near = indels.where("length IS NOT NULL").select("target", (F.col("at") - 1).alias("start"), (F.col("at") + 1).alias("end"), "at", "length", "deletion")
    asked = own.where("seq IS NOT NULL AND start IS NOT NULL").select("__id", "target", "start", "end", F.length("seq").alias("__n"))
    pairs = overlap_join(asked, near, ["target"], reach).select("l.*", "r.at", "r.length", "r.deletion")
    one = lambda c: F.first(c).alias(c)
    own_indels = pairs.groupBy("__id").agg(one("target"), one("start"), one("__n"), F.max("length").alias("__most"), F.collect_list(F.struct("at", "length", "deletion")).alias("__indels"))
    own_indels = stored(own_indels)
    low = F.greatest(F.col("start") - F.col("__most"), F.lit(0))
    high = F.col("start") + F.col("__n") + F.col("__most")
    blocks = F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))
    pieces = own_indels.select("__id", "target", blocks.alias("block")).join(genome.select("target", "block", F.col("bases").alias("__piece")), ["target", "block"])
    around = pieces.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("block", "__piece"))).alias("__p"))
    stretch = around.select("__id", (F.element_at("__p", 1)["block"] * size).alias("__begin"), F.array_join(F.transform("__p", lambda x: x["__piece"]), "").alias("__genome"))
    kinds = dict(pairs.dtypes)
    wanted = own_indels.select("__id", "start", "__indels").join(stretch, "__id").join(own.select("__id", "seq"), "__id").select("__id", "start", "__indels", "__begin", "__genome", "seq")
    shape = f"__id bigint, shift struct<at:{kinds['at']},length:{kinds['length']},deletion:boolean>, gain bigint"
    best = wanted.mapInPandas(_best_shifts, shape)
    return own.join(best, "__id", "left").drop("__id").withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0)))


def _best_shifts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(__id, shift, gain) of the reads of ``realigned`` that gain by one of their indels."""
    for b in batches:
        ids, shifts, gains = [], [], []
        for i, start, indels, begin, genome, seq in zip(b["__id"], b["start"], b["__indels"], b["__begin"], b["__genome"], b["seq"], strict=True):
            read, around = _codes(seq), _codes(genome)
            each = ((realign_score(read, around, int(start - begin), int(x["at"] - begin), int(x["length"]), bool(x["deletion"])), x["at"], x["length"], bool(x["deletion"])) for x in indels)
            gain, at, length, deletion = max(each)
            if gain > 0:
                ids.append(i)
                shifts.append({"at": at, "length": length, "deletion": deletion})
                gains.append(gain)
        yield pd.DataFrame({"__id": ids, "shift": shifts, "gain": gains})


def indel_alleles(df: DataFrame, source: str, targets: str) -> DataFrame:
    """``df`` with ``ref`` and ``alts`` of a gapped allele and the array of its alternates (C16); null alleles stay null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(None, None) if s is None or t is None else vcf_indel(s, list(t)) for s, t in zip(b[source], b[targets], strict=True)]
            b["ref"], b["alts"] = [g[0] for g in got], [g[1] for g in got]
            yield b

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, ref string, alts array<string>")


def with_links(aligned: DataFrame) -> DataFrame:
    """Alignment rows with splice_forward, splice_backward and pair_link, each (target, position, fragment_index) or null.

    The next and the previous segment of the same record, and the first segment of the
    mate, told by the flag of the second in pair.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("qname", "pair_flags").orderBy("fragment_index")
    here = F.struct("target", "position", "fragment_index")
    second = F.col("pair_flags").bitwiseAND(128) != 0
    own = aligned.withColumns({"splice_forward": F.lead(here).over(w), "splice_backward": F.lag(here).over(w), "__second": second})
    mates = aligned.groupBy(F.col("qname").alias("__q"), (~second).alias("__other")).agg(F.min_by(here, F.struct("fragment_index", "target", "position")).alias("pair_link"))
    return own.join(mates, (F.col("qname") == F.col("__q")) & (F.col("__second") == F.col("__other")), "left").drop("__q", "__other", "__second")
