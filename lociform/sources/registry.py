"""One entry for data sets of several formats (S5, S12): a reader by the format's name or the path's ending, then filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from lociform.operators import variants as va
from lociform.sources import blocks, text, tracks

Reader = Callable[[SparkSession, str], DataFrame]
READERS: dict[str, Reader] = {}
ENDINGS: dict[str, str] = {}


def reader(name: str, *endings: str):
    """Registers a reader under a name and under endings of paths; others may add theirs."""

    def put(f: Reader) -> Reader:
        READERS[name] = f
        ENDINGS.update({e: name for e in endings})
        return f

    return put


reader("parquet", ".parquet", ".entries")(lambda spark, path: spark.read.parquet(path))
reader("sam", ".sam")(lambda spark, path: va.alignments(text.read_sam(spark, path, ["MD", "NH"])))
reader("maf", ".maf")(blocks.read_maf)
reader("fasta", ".fa", ".fasta")(text.read_fasta)
reader("fastq", ".fq", ".fastq")(text.read_fastq)
reader("vcf", ".vcf")(text.read_vcf)
reader("tsv", ".tsv")(text.read_tsv)
reader("bedgraph", ".bedgraph", ".bg")(tracks.read_bedgraph)


def read(spark: SparkSession, path: str, kind: str | None = None, steps: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """The data set of a path, through filters in order; without a kind the path's ending tells it."""
    bare = path.rstrip("/").removesuffix(".gz")
    if kind is None:
        kind = next((name for end, name in ENDINGS.items() if bare.endswith(end)), None)
    if kind not in READERS:
        raise ValueError(f"no reader for {path}: known are {', '.join(sorted(READERS))}")
    df = READERS[kind](spark, path)
    for step in steps:
        df = step(df)
    return df
