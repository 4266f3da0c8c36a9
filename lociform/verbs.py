"""Whole programs by name: tables or text files in, a DataFrame out.

``run(spark, name, **options)`` looks a verb up; ``python -m lociform NAME key=value ...``
does the same from a shell and writes the result to ``output``. Options are strings on the
command line and are brought to the type of the verb's default. Paths of tables are Parquet.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociform.functions import sequences as sq
from lociform.operators import coverage as cv
from lociform.operators import discovery as di
from lociform.operators import export as ex
from lociform.operators import filters as fi
from lociform.operators import intervals as iv
from lociform.operators import lookups as lo
from lociform.operators import reads as rd
from lociform.operators import sets as se
from lociform.operators import statistics as st
from lociform.operators import variants as va
from lociform.operators import windows as wi
from lociform.sources import archive, blocks, chunks, registry, text, tracks

VERBS: dict[str, Callable[..., DataFrame]] = {}
KEY = ["target"]


def verb(name: str):
    """Registers ``f(spark, ...)`` under a name; other packages may add their own."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        VERBS[name] = f
        return f

    return put


def run(spark: SparkSession, name: str, **options) -> DataFrame:
    """The verb's result; text options become bool, int or float where its default is one."""
    f = VERBS[name]
    defaults = {k: p.default for k, p in inspect.signature(f).parameters.items()}
    for k, v in options.items():
        if k not in defaults:
            raise ValueError(f"{name} has no option {k}; it has {', '.join(list(defaults)[1:])}")
        if isinstance(v, str) and isinstance(defaults[k], bool):
            options[k] = v.lower() in ("1", "true", "yes")
        elif isinstance(v, str) and isinstance(defaults[k], (int, float)):
            options[k] = type(defaults[k])(v)
    return f(spark, **options)


def options_of(text: str) -> dict[str, dict[str, str]]:
    """"name:key=value:key=value,name:..." as options by name (E12); later ones replace earlier ones."""
    found: dict[str, dict[str, str]] = {}
    for part in filter(None, text.split(",")):
        name, *pairs = part.split(":")
        found.setdefault(name.strip(), {}).update(p.split("=", 1) for p in pairs)
    return found


def _all(spark: SparkSession, paths: str) -> list[DataFrame]:
    return [spark.read.parquet(p) for p in paths.split(",")]


# counts and annotations


@verb("alignment-to-counts")
def alignment_to_counts(spark, input: str, closed: bool = False) -> DataFrame:
    """Coverage runs of alignments (target, start, end)."""
    return cv.coverage(spark.read.parquet(input), KEY, "start", "end", closed=closed)


@verb("alignment-to-annotation-counts")
def alignment_to_annotation_counts(spark, input: str, annotations: str) -> DataFrame:
    """Segments with the number of alignments that overlap them."""
    return iv.overlap_counts(spark.read.parquet(input), spark.read.parquet(annotations), KEY)


@verb("alignment-to-segment-counts")
def alignment_to_segment_counts(spark, input: str, annotations: str) -> DataFrame:
    """Segments with reads inside and over them, lengths and normalised counts."""
    return iv.annotation_counts(spark.read.parquet(input), spark.read.parquet(annotations), KEY)


@verb("alignment-to-transcript-counts")
def alignment_to_transcript_counts(spark, input: str) -> DataFrame:
    got = spark.read.parquet(input).groupBy("target").agg(F.count("*").alias("n"))
    return got.withColumn("log10_n", sq.log10p1(F.col("n")))


@verb("annotations-to-counts")
def annotations_to_counts(spark, annotations: str, flank: int = 0) -> DataFrame:
    wide = spark.read.parquet(annotations).withColumns({"start": F.greatest(F.col("start") - flank, F.lit(0)), "end": F.col("end") + flank})
    merged = cv.merged_intervals(wide, KEY, "start", "end")
    return merged.select("target", "start", (F.col("end") - F.col("start")).alias("length"), F.lit(1).cast("long").alias("count"))


@verb("coverage")
def coverage_statistics(spark, counts: str, annotations: str) -> DataFrame:
    """One row of average depths and enrichment."""
    return cv.capture_summary(cv.captured(spark.read.parquet(counts), spark.read.parquet(annotations), KEY))


@verb("counts-to-bedgraph")
def counts_to_bedgraph(spark, counts: str) -> DataFrame:
    return tracks.bedgraph_rows(spark.read.parquet(counts), "target")


@verb("counts-to-wiggle")
def counts_to_wiggle(spark, counts: str, resolution: int = 20) -> DataFrame:
    return cv.wiggle(spark.read.parquet(counts), KEY, resolution)


@verb("count-archive-to-peak-annotations")
def peak_annotations(spark, counts: str, threshold: int = 1) -> DataFrame:
    """Peaks of the sum of several step functions."""
    union = cv.step_union({f"c{i}": df for i, df in enumerate(_all(spark, counts))}, KEY)
    return cv.peaks(union.select("target", "start", "length", F.col("total").alias("count")), KEY, threshold)


@verb("aggregate-by-peak-distance")
def aggregate_by_distance(spark, peaks: str, threshold: int = 0, anchor: str = "first") -> DataFrame:
    return wi.anchored(spark.read.parquet(peaks), KEY, threshold, anchor)


@verb("annotation-penalty")
def annotation_penalty(spark, a: str, b: str) -> DataFrame:
    return cv.set_distance(*_all(spark, f"{a},{b}"), KEY)


@verb("suggest-position-slices")
def position_slices(spark, input: str, slices: int = 100) -> DataFrame:
    return wi.slices(spark.read.parquet(input).select("target", "start"), "target", "start", slices)


# alignments


@verb("concatenate-alignments")
def concatenate_alignments(spark, inputs: str) -> DataFrame:
    return se.concatenated(_all(spark, inputs))


@verb("merge-compact-alignments")
def merge_alignments(spark, inputs: str, most: int = 0) -> DataFrame:
    """Best alignments of each query over inputs; those with more than ``most`` are left out unless it is 0."""
    return fi.best_score(se.concatenated(_all(spark, inputs)), "query", "score", most or None)


@verb("diff-alignments")
def diff_alignments(spark, a: str, b: str, columns: str = "target,score") -> DataFrame:
    left, right = _all(spark, f"{a},{b}")
    return se.diff(left, right, "query", columns.split(","))


@verb("sort")
def sort(spark, input: str, keys: str = "target,start") -> DataFrame:
    return spark.read.parquet(input).orderBy(*keys.split(","))


@verb("compact-file-stats")
def file_statistics(spark, input: str, length: str = "length") -> DataFrame:
    return rd.overview(spark.read.parquet(input), length)


@verb("infer-sex")
def infer_sex(spark, input: str, sample: str = "sample") -> DataFrame:
    return rd.sex_ratio(spark.read.parquet(input), sample, "target")


@verb("alignment-to-pileup")
def alignment_to_pileup(spark, input: str, low: int = 0, high: int = 80) -> DataFrame:
    return lo.pileup_view(spark.read.parquet(input), "start", "seq", low, high)


@verb("alignment-to-text")
def alignment_to_text(spark, input: str) -> DataFrame:
    return text.as_text(spark.read.parquet(input))


@verb("sam-to-compact")
def sam_to_compact(spark, input: str) -> DataFrame:
    return va.alignments(text.read_sam(spark, input))


@verb("sam-extract-reads")
def sam_extract_reads(spark, input: str) -> DataFrame:
    return text.unaligned(text.read_sam(spark, input))


@verb("last-to-compact")
def last_to_compact(spark, input: str) -> DataFrame:
    return blocks.read_maf(spark, input)


@verb("extract-splicing-events")
def splicing_events(spark, input: str, quality: int = 0) -> DataFrame:
    return va.splice_events(spark.read.parquet(input), quality)


@verb("display-sequence-variations")
def sequence_variations(spark, input: str) -> DataFrame:
    return va.variation_rows(spark.read.parquet(input))


# reads


@verb("fasta-to-compact")
def fasta_to_compact(spark, input: str, fastq: bool = False) -> DataFrame:
    return text.read_fastq(spark, input) if fastq else text.read_fasta(spark, input)


@verb("compact-to-fasta")
def compact_to_fasta(spark, input: str, quality: bool = False) -> DataFrame:
    return text.fasta_lines(spark.read.parquet(input), "header", "seq", "quality" if quality else None)


@verb("tally-reads")
def tally_reads(spark, input: str) -> DataFrame:
    return rd.tally(spark.read.parquet(input), "seq")


@verb("base-stats")
def base_stats(spark, input: str, words: str = "A,C,G,T,N,CA,CC,CG,CT") -> DataFrame:
    return rd.composition(spark.read.parquet(input), "seq", words.split(","))


@verb("read-quality-stats")
def read_quality_stats(spark, input: str, encoding: str = "sanger") -> DataFrame:
    return rd.quality_by_position(spark.read.parquet(input), "quality", encoding)


@verb("trim")
def trim(spark, input: str, adapters: str, left: int = 1, right: int = 1) -> DataFrame:
    cut = fi.trimmed(F.col("seq"), adapters.split(","), left, right)
    return spark.read.parquet(input).withColumn("seq", cut).where("seq != ''")


@verb("barcode-decoder")
def barcode_decoder(spark, input: str, codes: str, allowed: int = 1, at_end: bool = False) -> DataFrame:
    return fi.barcodes(spark.read.parquet(input), "seq", codes.split(","), allowed, at_end)


@verb("bisulfite-conversion")
def bisulfite_conversion(spark, input: str) -> DataFrame:
    return spark.read.parquet(input).withColumn("seq", sq.bisulfite(F.col("seq")))


@verb("simulate-reads")
def simulate_reads(spark, genome: str, n: int = 1000, length: int = 50, seed: int = 1) -> DataFrame:
    return rd.simulated(spark, n, genome, length, seed)


# variants and statistics


@verb("vcf-subset")
def vcf_subset(spark, input: str, samples: str, only_variants: bool = True) -> DataFrame:
    return text.vcf_subset(text.read_vcf(spark, input), samples.split(","), only_variants)


@verb("vcf-to-tab")
def vcf_to_tab(spark, input: str, info: str = "", samples: str = "", fields: str = "GT") -> DataFrame:
    return text.vcf_to_tab(text.read_vcf(spark, input), [x for x in info.split(",") if x], {s: fields.split(",") for s in samples.split(",") if s})


@verb("vcf-to-genotype-map")
def vcf_to_genotype_map(spark, input: str) -> DataFrame:
    calls = text.read_vcf(spark, input).select("chrom", "pos", F.explode(F.split(F.concat_ws(",", "ref", "alt"), ",")).alias("allele"))
    return lo.variant_map(calls, ["chrom", "pos"], "allele")


@verb("vcf-to-indel-set")
def vcf_to_indel_set(spark, input: str) -> DataFrame:
    return lo.indel_positions(text.read_vcf(spark, input), ["chrom", "pos"], "ref", F.split("alt", ","))


@verb("vcf-compare")
def vcf_compare(spark, a: str, b: str) -> DataFrame:
    """Positions of both files with the class of their disagreement."""
    left, right = (vcf_to_genotype_map(spark, p) for p in (a, b))
    return se.compare_calls(left, right, ["chrom", "pos"], "alleles")


@verb("discover-sequence-variants")
def discover_sequence_variants(spark, input: str, format: str = "genotypes") -> DataFrame:
    """Observations of bases (pos, sample, grp, allele, strand, quality, read_index) in an output format."""
    return di.discover(spark.read.parquet(input), format)


@verb("sequence-variation-stats")
def sequence_variation_stats(spark, input: str, by: str = "sample") -> DataFrame:
    return di.by_read_index(spark.read.parquet(input), by)


@verb("tally-bases")
def tally_bases(spark, a: str, b: str, least: int = 30, cutoff: float = 0.0) -> DataFrame:
    """Log fold changes of two step functions over the segments of both."""
    one, two = _all(spark, f"{a},{b}")
    both = cv.step_union({"a": one, "b": two}, KEY)
    return st.tally_bases(both, ["target", "start", "length"], least, cutoff)


@verb("tally-offsets")
def tally_offsets(spark, a: str, b: str, reach: int = 10) -> DataFrame:
    return st.offset_differences(*_all(spark, f"{a},{b}"), KEY, reach)


@verb("compact-to-sam")
def compact_to_sam(spark, input: str) -> DataFrame:
    return ex.sam_records(spark.read.parquet(input))


@verb("alignment-links")
def alignment_links(spark, input: str) -> DataFrame:
    """SAM text as alignment rows with links to neighbours and mates."""
    return va.with_links(va.alignments(text.read_sam(spark, input)))


@verb("targets")
def targets(spark, input: str) -> DataFrame:
    """The references of a data set with their rows and last position."""
    return spark.read.parquet(input).groupBy("target").agg(F.count("*").alias("n"), F.max("end").alias("last"))


@verb("version")
def version(spark) -> DataFrame:
    """This package's and Spark's version."""
    return spark.createDataFrame([("lociform", "0.2"), ("spark", spark.version)], "name string, version string")


@verb("read")
def read(spark, input: str, kind: str = "") -> DataFrame:
    """A data set of any registered format."""
    return registry.read(spark, input, kind or None)


@verb("counts-archive")
def counts_archive(spark, input: str, member: str = "", target: str = "") -> DataFrame:
    """Totals of an archive, or one member's runs."""
    return archive.read_counts(spark, input, member, target or None) if member else archive.totals(spark, input)


@verb("expand-chunks")
def expand_chunks(spark, input: str) -> DataFrame:
    return chunks.read_chunks(spark, input)


@verb("fdr")
def fdr(spark, inputs: str, p: str = "p", key: str = "element", threshold: float = 0.05) -> DataFrame:
    """Rows of tab-separated tables whose adjusted p is at most the threshold."""
    parts = [text.read_tsv(spark, path) for path in inputs.split(",")]
    return st.fdr(parts, p.split(","), key, 1.0 if threshold >= 1 else threshold, threshold)


@verb("stats")
def stats(spark, counts: str, groups: str, compare: str, normalization: str = "aligned-count") -> DataFrame:
    """(element, averages' folds, tests and adjusted p) of counts (element, sample, count, length); groups as "A=s1,s2/B=s3,s4", compare "A/B"."""
    a, b = st.comparisons_of(compare)[0]
    own = st.with_groups(spark.read.parquet(counts), groups)
    values = st.normalized(own, normalization)
    folds = st.fold_changes(st.group_averages(values), a, b)
    tests = st.t_test_p(st.t_tests(values, a, b))
    exact = st.fisher(st.two_by_two(own, a, b)).select("element", F.col("p").alias("p_fisher"))
    both = folds.join(exact, "element", "left").join(tests, "element", "left")
    return st.benjamini_hochberg(both, "p_fisher", "element")


@verb("empirical-p")
def empirical_p(spark, null: str, observed: str, strict: bool = True) -> DataFrame:
    """observed (bin, s, ...) with a p-value against null (bin, s)."""
    return st.empirical(spark.read.parquet(null), spark.read.parquet(observed), strict=strict)


@verb("run-parallel")
def run_parallel(spark, input: str, command: str, slices: int = 8) -> DataFrame:
    """What a shell command writes for each slice of a text file's lines."""
    return lo.piped(spark.read.text(input).repartition(slices), "value", ["sh", "-c", command])


@verb("files-to-attributes")
def files_to_attributes(spark, input: str, names: str) -> DataFrame:
    return text.attributes_of_files(spark, input, names.split(","))
