"""Column functions on sequences, qualities, flags and genotype codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Offset and least score by encoding (C4).
ENCODINGS = {"sanger": (33, 0), "illumina": (64, 0), "solexa": (64, -5), "phred": (0, 0)}


_LETTERS, _STAND_FOR = b"acgtbdefhijklmnopqrsuvwxyz", b"ACGTACGTACGTACGTACGTACGTAC"
#: The base that a letter of either case stands for, by its byte, and the bytes that stand for none.
LETTER_BASES = bytes.maketrans(_LETTERS + _LETTERS.upper(), _STAND_FOR * 2)
NO_LETTERS = bytes(set(range(256)) - set(_LETTERS + _LETTERS.upper()))


@F.arrow_udf(StringType())
def letters_as_bases(text: pa.Array) -> pa.Array:
    """The letters of texts as bases, in one pass over their bytes; all else is left out.

    Of other characters only U+0130 and U+212A are letters in lower case, i and k.
    """
    own = (None if x is None else x.replace(b"\xc4\xb0", b"i").replace(b"\xe2\x84\xaa", b"k").translate(LETTER_BASES, NO_LETTERS) for x in text.cast(pa.binary()).to_pylist())
    return pa.array(own, pa.binary()).cast(pa.string())


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def bisulfite(seq: Column) -> Column:
    """C to T (C2)."""
    return F.translate(seq, "Cc", "Tt")


def _bases(upper: bool) -> np.ndarray:
    """Number of a base by its byte, 4 for all else."""
    own = np.full(256, 4, np.uint8)
    for i, b in enumerate("ACGT"):
        own[ord(b)] = i
        if not upper:
            own[ord(b.lower())] = i
    return own


def _bytes(s: str) -> np.ndarray:
    """One byte for each character, "?" for those beyond Latin-1."""
    return np.frombuffer(s.encode("latin-1", "replace"), np.uint8)


def colors_of(s: str | None) -> str | None:
    if s is None or len(s) < 2:
        return s
    b = _bases(False)[_bytes(s)]
    known = (b[1:] < 4) & (b[:-1] < 4)
    return s[0] + np.where(known, (b[1:] ^ b[:-1]) + 48, 46).astype(np.uint8).tobytes().decode()


def bases_of(s: str | None) -> str | None:
    if s is None or len(s) < 2:
        return s
    b = _bytes(s)
    steps = np.concatenate([_bases(True)[b[:1]], b[1:] - 48])  # bytes below "0" wrap around
    unknown = np.flatnonzero(steps > 3)
    upto = int(unknown[0]) if len(unknown) else len(s)
    known = np.frombuffer(b"ACGT", np.uint8)[np.bitwise_xor.accumulate(steps[:upto])].tobytes().decode()
    return s[0] + known[1:] + "N" * (len(s) - max(upto, 1))


@F.pandas_udf(StringType())
def _encoded(seq: pd.Series) -> pd.Series:
    return seq.map(colors_of, na_action="ignore")


@F.pandas_udf(StringType())
def _decoded(code: pd.Series) -> pd.Series:
    return code.map(bases_of, na_action="ignore")


def color_encode(seq: Column) -> Column:
    """First base, then a digit for each pair of neighbours; "." where a base is unknown."""
    return _encoded(seq)


def color_decode(code: Column) -> Column:
    """Bases from the first base and the digits behind it; N from the first unknown digit on."""
    return _decoded(code)


def phred(quality: Column, encoding: str = "sanger") -> Column:
    """array<int> of the scores in a quality string (C4)."""
    offset, least = ENCODINGS[encoding]
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.greatest(F.ascii(c) - offset, F.lit(least)))


def to_quality(scores: Column, encoding: str = "sanger") -> Column:
    """The quality string of array<int> scores (C4)."""
    return F.array_join(F.transform(scores, lambda s: F.char(s + ENCODINGS[encoding][0])), "")


def encoding_of(least: Column, most: Column) -> Column:
    """Encoding by the range of codes."""
    return F.when(least < 59, "sanger").when(least < 64, "solexa").when(most > 74, "illumina").otherwise("unknown")


def base_share(seq: Column, bases: str) -> Column:
    """Share of a sequence's characters that are among ``bases``, in either case."""
    both = "".join(sorted(set(bases.upper() + bases.lower())))
    return F.when(F.length(seq) > 0, 1 - F.length(F.translate(seq, both, "")) / F.length(seq))


def gc_correction(seq: Column) -> Column:
    """10.4436 - 8.266972 * GC / (AT + GC)."""
    gc, at = base_share(seq, "GC"), base_share(seq, "AT")
    return F.when(gc + at > 0, 10.4436 - 8.266972 * gc / (gc + at))


def log2p1(x: Column) -> Column:
    return F.log1p(x.cast("double")) / F.log(F.lit(2.0))


def log10p1(x: Column) -> Column:
    return F.log10(x.cast("double") + 1)


#: Fixed values of the gene-bias formulas: constant, slope of ln(count), of ln(weight), of ln(weight / count),
#: what is added to count and weight, and whether the result is of single precision.
BIAS = {
    1: (-0.898699452975139, 4.32171188401506, -3.42375631012767, 0.0, 0, True),
    2: (-1.57361718748031, 1.0, 0.0, -3.62887641327823, 0, True),
    3: (-0.843924877396631, 0.887303234304011, 0.0, -3.45874660923795, 1, False),
    4: (-1.4050204825287, 1.0, 0.0, -3.5820783386146, 0, True),
}


def bias_formula(kind: int, count: Column, weight: Column) -> Column:
    """Expression corrected for a gene's bias (C11): log-linear in count and summed weight; 0 without reads, the count without weight."""
    const, of_count, of_weight, of_ratio, plus, single = BIAS[kind]
    c, w = F.log(count.cast("double") + plus), F.log(weight.cast("double") + plus)
    value = F.exp(const + of_count * c + of_weight * w + of_ratio * (w - c))
    value = value.cast("float").cast("double") if single else value
    return F.when(count == 0, 0.0).when(weight == 0, count.cast("double")).otherwise(value)


def flag(flags: Column, bit: int) -> Column:
    """Whether a SAM flag bit is set (C14)."""
    return flags.bitwiseAND(bit) != 0


FLAGS = {1: "PAIRED", 2: "PROPERLY_PAIRED", 4: "READ_UNMAPPED", 8: "MATE_UNMAPPED", 16: "READ_REVERSE_STRAND", 32: "MATE_REVERSE_STRAND", 64: "FIRST_IN_PAIR", 128: "SECOND_IN_PAIR", 256: "NOT_PRIMARY_ALIGNMENT"}


def flag_names(flags: Column) -> Column:
    """Names of the bits set, joined by a bar (C14)."""
    return F.concat_ws("|", *(F.when(flag(flags, b), n) for b, n in FLAGS.items()))


def decoded_genotype(code: Column, ref: Column, alts: Column) -> Column:
    """"0/1" with REF and comma-separated ALT as alleles, "A/G"; phase marks become slashes (C17)."""
    alleles = F.concat(F.array(ref), F.split(alts, ","))
    parts = F.split(F.replace(code, F.lit("|"), F.lit("/")), "/")
    return F.array_join(F.transform(parts, lambda p: F.when(p == ".", ".").otherwise(F.get(alleles, p.try_cast("int")))), "/", ".")


def coded_genotype(called: Column, ref: Column, alts: Column) -> Column:
    """Alleles "A/G" as indices into REF and ALT (C17)."""
    alleles = F.concat(F.array(ref), F.split(alts, ","))
    return F.array_join(F.transform(F.split(called, "/"), lambda a: F.when(F.array_position(alleles, a) > 0, (F.array_position(alleles, a) - 1).cast("string")).otherwise(".")), "/")


def context(next_base: Column) -> Column:
    """CpG, CpA, CpT, CpC or CpN by the base behind a cytosine."""
    b = F.upper(next_base)
    return F.concat(F.lit("Cp"), F.when(b.isin("A", "C", "G", "T"), b).otherwise("N"))


def repeat_length(seq: Column, unit: Column) -> Column:
    """Times that ``unit`` stands at the start of ``seq`` without gap (C20)."""
    n = F.length(unit)
    most = F.floor(F.length(seq) / n)
    # halving steps: a sequence that begins with k units begins with fewer of them too
    steps = F.transform(F.sequence(F.floor(F.log2(most)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2.0), i).cast("int"))
    longer = lambda k, x: F.when((k + x <= most) & F.startswith(seq, F.repeat(unit, F.least(k + x, most).cast("int"))), k + x).otherwise(k)
    return F.when((n > 0) & (F.length(seq) >= n), F.aggregate(steps, F.lit(0), longer)).otherwise(0)


def masked_crc(seq: Column, mask: str) -> Column:
    """CRC-32 of the characters whose place in ``mask`` is 1."""
    kept = [F.substring(seq, i + 1, 1) for i, m in enumerate(mask) if m == "1"]
    return F.crc32(F.concat(*kept).cast("binary"))


def segment_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether closed segments overlap (C23; Q8)."""
    return (s1 <= e2) & (s2 <= e1)


def segment_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """0 if they overlap, else the gap; never negative (C23; Q8)."""
    return F.greatest(F.lit(0), s2 - e1, s1 - e2)


def segment_length(s: Column, e: Column) -> Column:
    """Positions of a closed segment."""
    return e - s + 1


def segment_merge(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct<start, end> from the smaller start to the larger end."""
    return F.struct(F.least(s1, s2).alias("start"), F.greatest(e1, e2).alias("end"))


def gap_length(a: Column, b: Column) -> Column:
    """Gap marks of the allele that has more of them (C20), null where one is null."""
    n = lambda c: F.length(c) - F.length(F.replace(c, F.lit("-"), F.lit("")))
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(n(a), n(b)))
