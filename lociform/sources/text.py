"""FASTA, FASTQ, VCF, SAM and TSV text as DataFrames, and back.

Readers use Spark's text source, so files of any store are split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq) of FASTA text."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    head = F.regexp_extract(text, "^([^\n]*)", 1)
    return raw.where("trim(value) != ''").select(head.alias("header"), F.regexp_replace(F.regexp_replace(text, "^[^\n]*", ""), "\\s", "").alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq, quality) of four-line FASTQ records (S13); blank lines at the end are allowed.

    The text is split at a line end and "@"; a quality that begins with "@" is cut off its
    record by that and joined again with the piece behind it.
    """
    raw = spark.read.option("lineSep", "\n@").text(path).select(F.replace("value", F.lit("\r"), F.lit("")).alias("v"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # the piece behind is in the same split, or the first one of the next split that has one: a row for each split
    firsts = raw.withColumn("i", F.monotonically_increasing_id()).groupBy("file", "block").agg(F.min_by("v", "i").alias("first"))
    follow = firsts.select("file", "block", F.lead("first").over(W.partitionBy("file").orderBy("block")).alias("follow"))
    records = raw.mapInArrow(_fastq_records, "header string, seq string, quality string, file string, block bigint")
    rest = F.regexp_replace(F.concat(F.lit("@"), F.coalesce("follow", F.lit(""))), "\n+$", "")
    return records.join(F.broadcast(follow), ["file", "block"], "left").select("header", "seq", F.coalesce("quality", rest).alias("quality"))


def _fastq_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(header, seq, quality, file, block) of the pieces of a task, in order: a record that its split ends in
    has a null quality and its split, all others have no split."""
    held = None

    def made(headers: list, seqs: list, qualities: list, file: str | None = None, block: int | None = None) -> pa.RecordBatch:
        n = len(headers)
        columns = [pa.array(x, pa.string()) for x in (headers, seqs, qualities, [file] * n)] + [pa.array([block] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["header", "seq", "quality", "file", "block"])

    for batch in batches:
        headers, seqs, qualities = [], [], []
        pieces, files, blocks = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        new = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(new) + 1).tolist(), len(pieces)] if pieces else []
        for low, high in zip([0, *ends], ends):
            split = files[low].as_py(), blocks[low].as_py()
            if held and held[2:] != split:
                yield made(*([x] for x in held[:2]), [None], *held[2:])
                held = None
            for v in pieces[low:high]:
                if held:
                    headers.append(held[0])
                    seqs.append(held[1])
                    qualities.append("@" + v.rstrip("\n"))
                    held = None
                lines = [x for x in v.split("\n") if x]
                if len(lines) > 3:
                    headers.append(lines[0].removeprefix("@"))
                    seqs.append(lines[1])
                    qualities.append(lines[3])
                elif len(lines) == 3:
                    held = lines[0].removeprefix("@"), lines[1], *split
        if headers:
            yield made(headers, seqs, qualities)
    if held:
        yield made(*([x] for x in held[:2]), [None], *held[2:])


def fasta_lines(reads: DataFrame, header: str, seq: str, quality: str | None = None) -> DataFrame:
    """FASTA or, with a quality column, FASTQ records as text rows."""
    if quality is None:
        return reads.select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value"))
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), header), seq, F.lit("+"), F.coalesce(F.col(quality), F.repeat(F.lit("I"), F.length(seq)))).alias("value"))


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated table with a header; types are inferred unless a schema is given (S22, 1.4)."""
    r = spark.read.option("sep", "\t").option("header", True).option("nanValue", "NaN").option("nullValue", "N/A")
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def column_types(df: DataFrame) -> DataFrame:
    """(column, type): Integer, Float or String by the values of string columns (tab-to-column-info)."""
    whole, real = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^NaN$"
    kind = lambda c: F.when(F.min(F.col(c).rlike(whole)), "Integer").when(F.min(F.col(c).rlike(real) | F.col(c).rlike(whole)), "Float").otherwise("String")
    got = df.agg(*(kind(c).alias(f"c{i}") for i, c in enumerate(df.columns)))
    return got.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("type")) for i, c in enumerate(df.columns)))).alias("x")).select("x.*")


VCF_FIXED = ["chrom", "pos", "id", "ref", "alt", "qual", "filter"]


def read_vcf(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, info, samples) of VCF text.

    info: map of names to values, "true" for flags; samples: map of sample names to maps of
    the row's own FORMAT. "." is null; rows may lack INFO, FORMAT and samples.
    """
    raw = spark.read.text(path)
    if samples is None:
        head = raw.where(F.col("value").startswith("#CHROM")).first()
        samples = head["value"].rstrip("\r").split("\t")[9:] if head else []
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    field = lambda i: F.nullif(F.get(f, F.lit(i)), F.lit("."))
    rows = raw.where("NOT startswith(value, '#') AND trim(value) != ''").select(f.alias("f"), field(0).alias("chrom"), field(1).cast("int").alias("pos"), *(field(i + 2).alias(n) for i, n in enumerate(VCF_FIXED[2:])), F.coalesce(field(7), F.lit("")).alias("i"), F.coalesce(field(8), F.lit("")).alias("fmt"))
    pair = lambda x: F.struct(F.split(x, "=", 2)[0].alias("key"), F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("true")).alias("value"))
    info = F.map_from_entries(F.transform(F.array_distinct(F.filter(F.split("i", ";"), lambda x: x != "")), pair))
    names = F.filter(F.split("fmt", ":"), lambda x: x != "")

    def values(k: int) -> Column:
        v = F.split(F.coalesce(F.get("f", F.lit(9 + k)), F.lit("")), ":")
        return F.map_from_entries(F.transform(names, lambda n, i: F.struct(n.alias("key"), F.nullif(F.nullif(F.get(v, i), F.lit(".")), F.lit("")).alias("value"))))

    every = F.map_from_arrays(F.array(*map(F.lit, samples)), F.array(*(values(k) for k in range(len(samples))))) if samples else F.create_map().cast("map<string,map<string,string>>")
    return rows.select("chrom", "pos", "id", "ref", "alt", F.col("qual").cast("double").alias("qual"), "filter", info.alias("info"), every.alias("samples"))


def vcf_lines(df: DataFrame, fields: list[str], samples: list[str]) -> DataFrame:
    """Rows of ``read_vcf``'s shape as VCF data lines, with a FORMAT of ``fields``."""
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    info = F.array_join(F.array_sort(F.transform(F.map_entries("info"), lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"])))), ";")
    of = lambda s: F.array_join(F.transform(F.array(*map(F.lit, fields)), lambda n: F.coalesce(F.element_at(F.element_at("samples", F.lit(s)), n), F.lit("."))), ":")
    cells = [*(dot(F.col(c)) for c in VCF_FIXED), F.when(info == "", ".").otherwise(info), *([F.lit(":".join(fields)), *map(of, samples)] if samples else [])]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def vcf_header(info: dict[str, tuple[str, str]], formats: dict[str, tuple[str, str]], samples: list[str]) -> list[str]:
    """Header lines that declare fields: name -> (type, description)."""
    meta = [f'##{kind}=<ID={n},Number=1,Type={t},Description="{d}">' for kind, fields in (("INFO", info), ("FORMAT", formats)) for n, (t, d) in fields.items()]
    return ["##fileformat=VCFv4.1", *meta, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])]


def vcf_subset(df: DataFrame, samples: list[str], only_variants: bool = True, flags: list[str] | None = None) -> DataFrame:
    """Some samples; rows in which one of them has an alternate; rows with INFO flags."""
    own = df.withColumn("samples", F.map_filter("samples", lambda k, v: k.isin(samples)))
    if only_variants:
        own = own.where(F.exists(F.map_values("samples"), lambda m: F.coalesce(F.element_at(m, F.lit("GT")), F.lit("")).rlike("[1-9]")))
    for flag in flags or []:
        own = own.where(F.map_contains_key("info", flag))
    return own


def vcf_to_tab(df: DataFrame, info: list[str], sample_fields: dict[str, list[str]]) -> DataFrame:
    """Chosen fields as columns."""
    return df.select("chrom", "pos", *(F.element_at("info", F.lit(n)).alias(n) for n in info), *(F.element_at(F.element_at("samples", F.lit(s)), F.lit(n)).alias(f"{n}[{s}]") for s, names in sample_fields.items() for n in names))


SAM_FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def read_sam(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """SAM text: the eleven fields and a map of tags, or a struct of the named ones."""
    f = F.split("value", "\t", 12)
    own = spark.read.text(path).where("NOT startswith(value, '@') AND value != ''")
    ints = {"flag", "pos", "mapq", "pnext", "tlen"}
    own = own.select(*(F.get(f, F.lit(i)).cast("int").alias(n) if n in ints else F.get(f, F.lit(i)).alias(n) for i, n in enumerate(SAM_FIELDS)), F.concat(F.lit("\t"), F.get(f, F.lit(11))).alias("rest"))
    # no functions of lambdas: they are interpreted, and so is the whole step
    found = lambda name, group: F.regexp_extract_all("rest", F.lit(f"\t({name}):[^\t]:([^\t]*)"), F.lit(group))
    every = F.map_from_entries(F.array_distinct(F.arrays_zip(found("[^\t]{2}", 1).alias("key"), found("[^\t]{2}", 2).alias("value"))))
    if tags is None:
        return own.select(*SAM_FIELDS, F.when(F.col("rest").isNotNull(), every).otherwise(F.create_map().cast("map<string,string>")).alias("tags"))
    own = own.select("*", *(found(n, 2).alias(f"all_{n}") for n in tags))
    # a tag that stands twice in a line is left to the map: once if its values are the same, else an error
    return own.select(*SAM_FIELDS, F.struct(*(F.when(F.size(f"all_{n}") < 2, F.get(f"all_{n}", F.lit(0))).otherwise(every[n]).alias(n) for n in tags)).alias("tags"))


def sam_lines(df: DataFrame) -> DataFrame:
    """SAM data lines of the fields and tags, a map or a struct."""

    def cell(key: Column, value: Column) -> Column:
        sign = F.rtrim(value, F.lit("0123456789"))
        return F.concat(key, F.when(sign.isin("", "-") & (sign != value), ":i:").otherwise(":Z:"), value)

    kind = df.schema["tags"].dataType
    if isinstance(kind, StructType):
        tags = [cell(F.lit(n), F.col("tags")[n]) for n in sorted(kind.fieldNames())]
    else:
        tags = [F.sort_array(F.transform(F.map_entries("tags"), lambda e: cell(e["key"], e["value"])))]
    return df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in SAM_FIELDS), *tags).alias("value"))


def unaligned(sam: DataFrame) -> DataFrame:
    """(name, mate, seq, quality) of unmapped reads, one for each name and mate, in read direction."""
    from lociform.functions import sequences as sq

    reverse = sq.flag(F.col("flag"), 16)
    mate = F.when(sq.flag(F.col("flag"), 128), 2).otherwise(1)
    own = sam.where(sq.flag(F.col("flag"), 4)).select(F.col("qname").alias("name"), mate.alias("mate"), F.when(reverse, sq.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(reverse, F.reverse("qual")).otherwise(F.col("qual")).alias("quality"))
    return own.groupBy("name", "mate").agg(F.min(F.struct("seq", "quality")).alias("r")).select("name", "mate", "r.*")


def as_text(df: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def attributes_of_files(spark: SparkSession, path: str, names: list[str], separator: str = "[-_.]") -> DataFrame:
    """One row for each file: its name and the name's parts as attributes."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    parts = F.split("file", separator)
    return files.select("file", *(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))
