"""Command lines: redundancy, curves, composition, ontology."""

from __future__ import annotations

import argparse
import logging
import time

from rarespan.config import Mating, Sampling

FOUND = 25  # between information and warnings
VERSION = "1.0"
LOG = logging.getLogger("rarespan")
#: Verbosity 0 to 9: nothing below 1, errors, warnings from 3, what a run finds from 5, steps from 7, all at 9.
LEVELS = (logging.CRITICAL, logging.ERROR, logging.ERROR, logging.WARNING, logging.WARNING, FOUND, FOUND, logging.INFO, logging.INFO, logging.DEBUG)


def positive(text: str) -> int:
    if int(text) < 1:
        raise argparse.ArgumentTypeError("a whole number above 0 is needed")
    return int(text)


def share(text: str) -> float:
    if not 0 < float(text) <= 1:
        raise argparse.ArgumentTypeError("a number above 0 and up to 1 is needed")
    return float(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rarespan")
    top.add_argument("-V", "--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)

    r = commands.add_parser("redundancy", help="rarefied redundancy of a read set")
    r.add_argument("-s", dest="reads", required=True, help="input sequences")
    r.add_argument("-T", dest="kernel", required=True, choices=("kmer", "alignment"))
    r.add_argument("-f", dest="form", required=True, choices=("fasta", "fastq"))
    r.add_argument("-b", dest="prefix", default="rarespan", help="prefix of outputs")
    r.add_argument("-X", dest="queries", type=int)
    r.add_argument("-x", dest="portion", type=float, default=0.0)
    r.add_argument("-k", dest="k", type=int, default=24)
    r.add_argument("-n", dest="replicates", type=int, default=1024)
    r.add_argument("-L", dest="overlap", type=float, default=50.0, help="percent of the shorter read")
    r.add_argument("-S", dest="similarity", type=float, default=0.95)
    r.add_argument("-d", dest="factor", type=float, default=0.7)
    r.add_argument("-m", dest="low", type=float, default=0.0)
    r.add_argument("-M", dest="high", type=float, default=1.0)
    r.add_argument("-i", dest="step", type=float, default=0.01)
    r.add_argument("-R", dest="memory", type=int, default=1024, help="MiB of driver memory in local mode")
    r.add_argument("-t", dest="threads", type=int, default=2)
    r.add_argument("-q", dest="other", help="a second dataset as queries")
    r.add_argument("-c", dest="one_strand", action="store_true")
    r.add_argument("-N", dest="n_mismatch", action="store_true")
    r.add_argument("-A", dest="adjust", action="store_true")
    r.add_argument("-F", dest="portion_label", action="store_true")
    r.add_argument("-r", dest="seed", type=int, default=int(time.time()), help="by default the time")
    r.add_argument("-a", dest="all_data", help="'' writes none, - to the standard output; so do -C and -o")
    r.add_argument("-C", dest="mates")
    r.add_argument("-o", dest="summary")
    r.add_argument("-l", dest="log", help="by default the standard error")
    r.add_argument("-v", dest="verbosity", type=int, default=7)

    c = commands.add_parser("curves", help="coverage, model and projections of curve files")
    c.add_argument("files", nargs="*")
    c.add_argument("--sheet", help="a table of File, Name and Col instead of files")
    c.add_argument("--labels", help="comma-separated; used again if there are fewer than files")
    c.add_argument("--col", help="comma-separated colours #rrggbb")
    c.add_argument("--star", type=float, default=95.0)
    c.add_argument("--json")
    c.add_argument("--tsv")
    c.add_argument("--csv")
    c.add_argument("--pdf")
    c.add_argument("--pdf-size", type=float, default=7.0, help="inches")
    c.add_argument("--xlim", default="1e3,10e12", help="least and most effort of the drawing")
    c.add_argument("--series", help="folder for plot-ready tables")
    c.add_argument("--dispersion", choices=("sd", "ci95", "ci90", "ci50", "iq"))
    c.add_argument("--weights", help="comma-separated exponents of the deviation, tried in order")
    c.add_argument("--skip-model", action="store_true")
    c.add_argument("--ignore-consistency", action="store_true")
    c.add_argument("--no-observed", action="store_true")
    c.add_argument("--no-model", action="store_true")
    c.add_argument("--no-correction", action="store_true")

    n = commands.add_parser("composition", help="poly-nucleotide counts")
    n.add_argument("-s", dest="reads", required=True)
    n.add_argument("-f", dest="form", default="fasta", choices=("fasta", "fastq"))
    n.add_argument("-k", dest="k", type=positive, default=1)
    n.add_argument("-o", dest="out", default="-", help="- (by default) is the standard output, '' writes nothing")
    n.add_argument("-e", dest="extended", action="store_true")
    n.add_argument("-z", dest="zeroes", action="store_true")
    n.add_argument("-x", dest="portion", type=share, default=1.0, help="chance of a sequence to be counted, above 0 up to 1")
    n.add_argument("-r", dest="seed", type=int, default=int(time.time()), help="by default the time")
    n.add_argument("-v", dest="verbosity", type=int, default=7)

    g = commands.add_parser("ontology", help="a dump as Parquet tables")
    g.add_argument("dump")
    g.add_argument("folder")
    g.add_argument("--skip", action="append", default=[], choices=("external", "synonyms", "definitions"))
    return top


def main(args: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(args)
    from rarespan.session import local_session

    handler = logging.FileHandler(a.log) if getattr(a, "log", None) else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("[%(relativeCreated)d ms] %(message)s"))
    LOG.handlers[:] = [handler]
    LOG.setLevel(LEVELS[max(0, min(9, getattr(a, "verbosity", 7)))])
    spark = spark or local_session(getattr(a, "threads", "*"), memory=f"{max(1024, getattr(a, 'memory', 4096))}m")
    {"redundancy": redundancy, "curves": curves, "composition": composition, "ontology": ontology}[a.command](spark, a)


def redundancy(spark, a) -> None:
    from rarespan.plans import redundancy as plan
    from rarespan.sources import sequences, sinks
    from rarespan.sources.result_file import emit

    mating = Mating(kernel=a.kernel, k=a.k, overlap=a.overlap / 100, similarity=a.similarity, both_strands=not a.one_strand, n_mismatch=a.n_mismatch)
    sampling = Sampling(max_queries=a.queries, query_portion=a.portion, replicates=a.replicates, factor=a.factor, low=a.low, high=a.high, step=a.step, seed=a.seed, portion_as_label=a.portion_label)
    subjects = sequences.read_sequences(spark, a.reads, a.form)
    other = sequences.read_sequences(spark, a.other, a.form) if a.other else None
    result = plan.run(subjects, mating, sampling, other, a.adjust)
    outputs = (
        (a.summary, ".npo", sinks.curve_text(result.summary, result.meta, result.meta["R"], a.portion_label)),
        (a.all_data, ".npa", sinks.replicate_lines(result.replicates).orderBy("portion_idx", "replicate")),
        (a.mates, ".npc", sinks.mate_lines(result.mates)),
    )
    for given, suffix, lines in outputs:
        emit(lines.select("value"), given if given is not None else f"{a.prefix}{suffix}" if a.prefix else "")
    for row in result.findings.collect():  # at most a few
        LOG.log(FOUND, "%s: %s", row["status"], row["message"])


def curves(spark, a) -> None:
    from pyspark.sql import functions as F

    from rarespan.operators import curve
    from rarespan.plans import curves as plan
    from rarespan.sources import sinks

    split = lambda text: text.split(",") if text else None
    options = dict(enforce=not a.ignore_consistency, star=a.star, corrected=not a.no_correction, weights=tuple(map(float, split(a.weights) or ())) or None, skip_model=a.skip_model)
    made = plan.read_sheet(spark, a.sheet, **options) if a.sheet else plan.read_set(spark, a.files, split(a.labels), split(a.col), **options)
    for row in made.warnings().collect():
        LOG.warning("%s: %s", row["label"], row["warning"])
    summary = made.summary()
    if a.json:
        sinks.write_json(made.json(), a.json)
    for form in ("tsv", "csv"):
        if getattr(a, form):
            sinks.write_summary(summary, getattr(a, form), form)
    if a.pdf:
        low, high = map(float, a.xlim.split(","))
        plan.draw(made, a.pdf, a.pdf_size, (low, high), a.dispersion, not a.no_observed, not a.no_model)
    if a.series:
        series = curve.plot_series(made.points, made.params)
        hidden = [n for n, off in (("observed", a.no_observed), ("model", a.no_model)) if off]
        series.where(~F.col("series").isin(*hidden) if hidden else F.lit(True)).write.mode("overwrite").parquet(f"{a.series}/series")
        curve.bands(made.points, a.dispersion or "sd").write.mode("overwrite").parquet(f"{a.series}/bands")
        curve.plot_guides(made.params, a.star).write.mode("overwrite").parquet(f"{a.series}/guides")
    summary.show(truncate=False)


def composition(spark, a) -> None:
    from rarespan.operators import composition as op
    from rarespan.sources import sequences, sinks
    from rarespan.sources.result_file import emit

    counted = op.counts(sequences.read_sequences(spark, a.reads, a.form), a.k, a.portion, a.seed)
    emit(sinks.composition_lines(op.with_zeroes(counted, a.k) if a.zeroes else counted, a.extended), a.out)


def ontology(spark, a) -> None:
    from rarespan.sources import dumps

    dumps.save(dumps.read_dump(spark, a.dump, tuple(a.skip)), a.folder)


if __name__ == "__main__":
    main()
