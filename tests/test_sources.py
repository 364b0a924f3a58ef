"""Files in, files out."""

import gzip
import json
import math
import os
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from rarespan.functions import gamma, sequence, sql
from rarespan.operators import composition, curve
from rarespan.plans import cli
from rarespan.plans import curves as plan
from rarespan.sources import curves, dumps, result_file, sequences, sinks


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    import random

    rng, d = random.Random(3), tmp_path_factory.mktemp("seqs")
    base = "".join(rng.choices("ACGT", k=2000))
    seqs = [base[(at := rng.randrange(0, 1900)) : at + 80] for _ in range(120)]
    fasta = "".join(f">r{i} x\n{s[:50]}\n{s[50:]}\n" for i, s in enumerate(seqs)) + ">empty\n"
    fastq = "".join(f"@r{i}\n{s}\n+\n{'@' * 80}\n" for i, s in enumerate(seqs))
    for name, text in (("a.fasta", fasta), ("a.fastq", fastq)):
        (d / name).write_text(text)
        with gzip.open(d / f"{name}.gz", "wt") as f:
            f.write(text)
    return d, seqs


@pytest.mark.parametrize("name,form", [("a.fasta", "fasta"), ("a.fasta.gz", "fasta"), ("a.fastq", "fastq"), ("a.fastq.gz", "fastq")])
def test_readers(spark, files, name, form):
    d, seqs = files
    rows = sequences.read_sequences(spark, str(d / name), form).orderBy("read_id").collect()
    assert [r["seq"] for r in rows] == seqs and [r["read_id"] for r in rows] == list(range(1, len(seqs) + 1))
    assert rows[0]["header"] == ("r0 x" if form == "fasta" else "r0")


def test_split_files_number_their_lines(spark, files):
    d, seqs = files
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for rows in (sequences.read_fastq(spark, str(d / "a.fastq")).collect(), sequences.read_fasta(spark, str(d / "a.fasta")).collect()):
            assert [r["seq"] for r in sorted(rows, key=lambda r: r["read_id"])] == seqs
            assert sorted(r["read_id"] for r in rows) == list(range(1, len(seqs) + 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ids_of_several_files_and_empty_records(spark, tmp_path):
    for name, first in (("a.fastq", 0), ("b.fastq", 100)):
        (tmp_path / name).write_text("".join(f"@r{first + i}\n{'' if i % 7 == 3 else 'ACGT'}\n+\n{'' if i % 7 == 3 else '@@II'}\n" for i in range(40)) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        rows = sorted(sequences.read_fastq(spark, str(tmp_path)).collect(), key=lambda r: r["read_id"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["header"] for r in rows] == [f"r{first + i}" for first in (0, 100) for i in range(40) if i % 7 != 3]
    assert [r["read_id"] for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("text,what", [("@a\nAC\n-\nII\n", "wrong separator"), ("@a\nAC\n+\n", "missing quality"), ("@a\n", "missing sequence"), ("@a\nAC\n", "missing separator")])
def test_broken_fastq(spark, tmp_path, text, what):
    (tmp_path / "b.fastq").write_text(text)
    with pytest.raises(Exception, match=what):
        sequences.read_fastq(spark, str(tmp_path / "b.fastq")).collect()


@pytest.mark.parametrize("kernel", ["kmer", "alignment"])
@pytest.mark.parametrize("name,form", [("a.fasta.gz", "fasta"), ("a.fastq", "fastq")])
def test_command_lines(spark, files, tmp_path, kernel, name, form):
    """A run, then curves of the file that it has written, under its own name."""
    d, _ = files
    out = str(tmp_path / "o")
    cli.main(["redundancy", "-s", str(d / name), "-T", kernel, "-f", form, "-X", "50", "-n", "32", "-b", out], spark)
    assert sorted(p.name for p in tmp_path.iterdir() if p.suffix != ".crc") == ["o.npa", "o.npc", "o.npo"]
    lines = (tmp_path / "o.npo").read_text().splitlines()
    head, rows = [x for x in lines if x.startswith("# @")], [x.split("\t") for x in lines if not x.startswith("#")]
    assert lines == head + ["\t".join(r) for r in rows] and "# @R: 120" in head and len(rows) >= 13
    assert [float(r[0]) for r in rows] == sorted(float(r[0]) for r in rows) and all(len(r) == 6 for r in rows)
    replicates = (tmp_path / "o.npa").read_text().splitlines()
    assert len(replicates) == 32 * len(rows) and [int(x.split("\t")[1]) for x in replicates[:33]] == [*range(32), 0]
    assert all(x.isdigit() for x in (tmp_path / "o.npc").read_text().splitlines())

    made = plan.read_set(spark, [f"{out}.npo"])
    assert sorted(tuple(r) for r in made.points.select("label", "x_obs", "red").collect()) == sorted(("o", float(r[0]), float(r[1])) for r in rows)
    meta = made.meta.head()
    assert (meta["label"], meta["R"], meta["kernel"]) == ("o", 120, kernel)
    cli.main(["curves", f"{out}.npo", "--json", str(tmp_path / "j"), "--tsv", str(tmp_path / "t"), "--csv", str(tmp_path / "t.csv"), "--series", str(tmp_path / "s")], spark)
    assert json.loads((tmp_path / "j").read_text())["o"]["label"] == "o"
    for file, sep in (("t", "\t"), ("t.csv", ",")):
        table = [x.split(sep) for x in (tmp_path / file).read_text().splitlines()]
        assert table[0] == ["label", "kappa", "C", "LR", "modelR", "LRstar", "diversity"] and len(table) == 2 and table[1][0] == "o"


def test_files_that_hold_no_curve(spark, tmp_path):
    (tmp_path / "empty.npo").write_text("")
    (tmp_path / "no_header.npo").write_text("0\t0\t0\t0\t0\t0\n")
    (tmp_path / "no_points.npo").write_text("# @R: 10\n")
    (tmp_path / "folder.npo").mkdir()
    (tmp_path / "folder.npo" / "part-0").write_text("# @R: 10\n1\t1\t0\t1\t1\t1\n")
    good = curve_file(tmp_path / "good.npo", 20.0, 1.5)
    for name in ("empty", "no_header", "no_points", "folder"):
        with pytest.raises(ValueError, match=name):
            plan.read_set(spark, [good, str(tmp_path / f"{name}.npo")])
    with pytest.raises(ValueError):
        plan.read_set(spark, [])


def test_one_file(spark, tmp_path):
    """Parts in order, a name that is taken, nothing left beside the file."""
    lines = spark.range(0, 5000, 1, 7).select(F.col("id").cast("string").alias("value"))
    target = tmp_path / "deep" / "a b.txt"
    for _ in range(2):
        result_file.write_lines(lines, str(target))
        assert target.read_text().split() == list(map(str, range(5000)))
    result_file.write_lines(lines.where("id < 0"), str(tmp_path / "none"))
    assert (tmp_path / "none").read_text() == ""
    with pytest.raises(IsADirectoryError):
        result_file.write_lines(lines, str(tmp_path / "deep"))
    with pytest.raises(Exception, match="broken on purpose"):
        result_file.write_lines(lines.select(F.when(F.col("value") == "4000", F.raise_error(F.lit("broken on purpose"))).otherwise(F.col("value"))), str(target))
    assert target.read_text().split() == list(map(str, range(5000)))
    assert [p.name for p in target.parent.iterdir() if p.suffix != ".crc"] == ["a b.txt"]


def curve_file(path, a, b, reads=10**8):
    """A curve that follows a model: redundancy = coverage ^ (1 / 0.914...), at the efforts that the adjustment undoes."""
    top = gamma.cdf(math.log1p(reads * 77.0), a, b)
    lines = ["# @impl: own", "# @ksize: 24", "# @version: 1.0", "# @L: 100.000", "# @AL: 77.000", f"# @R: {reads}", "# @overlap: 50.00", "# @divide: 0.70"]
    rows = [(0.0, 0.0)]
    for i in range(41):
        x = reads * 0.7 ** (40 - i)
        adjusted = math.exp(math.log(reads) + top**0.27 * (math.log(x) - math.log(reads))) * 77
        rows.append((x, gamma.cdf(math.log1p(adjusted), a, b) ** (1 / 0.9141196302)))
    path.write_text("\n".join([*lines, *(f"{x:.6f}\t{y:.12f}\t0.01\t{y:.12f}\t{y:.12f}\t{y:.12f}" for x, y in rows)]) + "\n")
    return str(path)


def test_sets_of_curves(spark, tmp_path):
    """Labels and colours that run out, a sheet, models known beforehand, exports and the drawing."""
    known = {"one": (60.0, 3.2), "two": (55.0, 3.1), "three": (70.0, 3.6)}
    files = [curve_file(tmp_path / f"{n}.npo", a, b) for n, (a, b) in known.items()]
    made = plan.read_set(spark, files, cols=["#102030", "#405060"])
    params = {r["label"]: r for r in made.params.collect()}
    for n, (a, b) in known.items():
        assert params[n]["a"] == pytest.approx(a, rel=1e-3) and params[n]["b"] == pytest.approx(b, rel=1e-3)
        assert params[n]["diversity"] == pytest.approx((a - 1) / b, rel=1e-3) and params[n]["modelR"] > 0.99999
        assert gamma.cdf(math.log1p(params[n]["LRstar"]), a, b) == pytest.approx(0.95, abs=1e-4)
    assert {r["label"]: r["col"] for r in made.meta.collect()} == {"one": "#102030", "two": "#405060", "three": "#102030"}
    with pytest.raises(ValueError):
        plan.read_set(spark, files, labels=["x", "y"])
    assert not plan.read_set(spark, files[:1], skip_model=True).params.where("has_model").count()
    assert plan.read_set(spark, files[:1], weights=(1.0,)).params.head()["weight_exp"] == 1.0
    both = plan.read_set(spark, files[:1]).add(plan.read_set(spark, files[1:]))
    assert both.summary().count() == 3

    (tmp_path / "sheet.tsv").write_text("File\tName\tCol\n" + "".join(f"{f}\tn{i}\t#00000{i}\n" for i, f in enumerate(files)))
    cli.main(["curves", "--sheet", str(tmp_path / "sheet.tsv"), "--json", str(tmp_path / "j"), "--pdf", str(tmp_path / "p.pdf"), "--pdf-size", "5", "--xlim", "1e3,1e13", "--dispersion", "ci95", "--csv", str(tmp_path / "c")], spark)
    out = json.loads((tmp_path / "j").read_text())
    assert sorted(out) == ["n0", "n1", "n2"] and out["n1"]["col"] == "#000001" and len(out["n0"]["x.model"]) == 1000 and len(out["n0"]) == 31
    pdf = (tmp_path / "p.pdf").read_bytes()
    assert pdf.startswith(b"%PDF-1.4") and pdf.count(b" S\n") > 10 and b"(n2)" in pdf and int(pdf.split(b"startxref\n")[1].split()[0]) == pdf.index(b"xref\n")


def test_outputs_to_nowhere_and_to_stdout(spark, files, tmp_path, capsys):
    d, _ = files
    out = str(tmp_path / "o")
    cli.main(["redundancy", "-s", str(d / "a.fasta"), "-T", "kmer", "-f", "fasta", "-X", "30", "-n", "8", "-b", out, "-o", "-", "-a", "", "-C", "-", "-r", "3"], spark)
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("# @impl") and len([x for x in lines if x.isdigit()]) == 30
    assert not list(tmp_path.iterdir())


def test_colours():
    assert plan.rgb("#ff0080") == (1.0, 0.0, pytest.approx(128 / 255)) and plan.with_alpha("#102030", 0.5) == "#10203080"
    assert plan.default_colour("a") == plan.default_colour("a") != plan.default_colour("b") and max(plan.rgb(plan.default_colour("a"))) < 200 / 255


def test_sql_names(spark):
    sql.register(spark)
    q = "SELECT is_mate('ACGTTGCAAGTCCGATAGCT', 'AGCTATCGGACTTGCAACGT', 0.5, 0.95) AS rc, is_mate('ACGTTGCAAGTCCGATAGCT', 'GGGGGGGGGGGGGGGGGGGG', 0.5, 0.95) AS no, is_mate(NULL, 'A', 0.5, 0.95) AS n, reverse_complement('ACN') AS r, phred_error('5') AS p, gamma_cdf(2.0D, 1.0D, 0.5D) AS g"
    row = spark.sql(q).head()
    assert (row["rc"], row["no"], row["n"], row["r"]) == (True, False, None, "NGT") and row["p"] == pytest.approx(0.01) and row["g"] == pytest.approx(1 - math.exp(-1))


def test_composition_command(spark, files, tmp_path, capsys):
    d, seqs = files
    command = ["composition", "-s", str(d / "a.fasta"), "-z", "-e"]
    cli.main([*command, "-o", str(tmp_path / "c")], spark)
    lines = (tmp_path / "c").read_text().splitlines()
    rows = [x.split("\t") for x in lines]
    assert [r[0] for r in rows] == list("NACGTRYSWKMBDHV.") and sum(int(r[1]) for r in rows) == sum(map(len, seqs)) and all(len(r) == 5 for r in rows)
    assert not capsys.readouterr().out
    for out in (["-o", "-"], []):
        cli.main([*command, *out], spark)
        assert capsys.readouterr().out.splitlines() == lines
    cli.main([*command, "-o", ""], spark)
    assert not capsys.readouterr().out and [p.name for p in tmp_path.iterdir() if p.suffix != ".crc"] == ["c"]
    for bad in (["-k", "0"], ["-x", "0"], ["-x", "1.5"]):
        with pytest.raises(SystemExit):
            cli.main([*command, *bad], spark)


def test_curve_metadata(spark, tmp_path):
    (tmp_path / "x.npo").write_text("# @impl: i\n# @ksize: 24\n# @version: 3.5\n# @L: 100.000\n# @AL: 77.000\n# @R: 1000\n# @overlap: 50.00\n# @divide: 0.70\n0\t0\t0\t0\t0\t0\n1000\t0.5\t0.1\t0.4\t0.5\t0.6\n")
    m = curves.read_metadata(spark, [str(tmp_path / "x.npo")]).head()
    assert (m["label"], m["kernel"], m["AL"], m["R"], m["ksize"], m["divide"]) == ("x", "kmer", 77.0, 1000, 24, 0.7)
    assert curves.read_metadata(spark, [str(tmp_path / "x.npo")], compat=True).head()["kernel"] == "alignment"
    p = curve.points(curves.read_points(spark, [str(tmp_path / "x.npo")]), curves.read_metadata(spark, [str(tmp_path / "x.npo")])).orderBy("i").collect()
    assert p[1]["x_adj"] == pytest.approx(77 * 1000) and p[0]["x_adj"] == 0
    assert p[1]["cov"] == pytest.approx(0.5**0.9141196302)
    sheet = spark.createDataFrame([(str(tmp_path / "x.npo"), "named", "red")], "File string, Name string, Col string")
    meta, raw = curves.read_set(spark, sheet)
    assert meta.head()["label"] == "named" and raw.count() == 2


def test_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("CREATE TABLE `term` (`id` int);\nINSERT INTO `term` VALUES (1,'all, of it','universal','all',0,1,0),(2,'it\\'s (b)','biological_process','GO:0000002',0,0,NULL);\nINSERT INTO `term_synonym` VALUES (1,'x');\nINSERT INTO `graph_path` VALUES (1,1,2,1,1,1),(1,1,2,1,1,1);\n")
    t = dumps.read_dump(spark, str(tmp_path / "d.sql"))
    assert [tuple(r) for r in t["term"].orderBy("id").collect()] == [(1, "all, of it", "universal", "all", 0, 1, 0), (2, "it's (b)", "biological_process", "GO:0000002", 0, 0, None)]
    assert t["graph_path"].count() == 1
    assert dumps.inserts(spark, str(tmp_path / "d.sql"), ("synonyms",)).where("table = 'term_synonym'").count() == 0
    cli.main(["ontology", str(tmp_path / "d.sql"), str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out/term")).count() == 2


NAMES = ["plain", "it's", "a; b", "two\nlines", "(a, 'b');\n", "back\\slash", 'say "x"', "-- no comment", "/* nor this */", "# nor that;", "tab\there", "", "ends with \\", "NULL", "INSERT INTO `term` VALUES (9);"]


def dump_text(rows: int) -> tuple[str, dict]:
    """A dump whose values hold all that ends a value, a line or a statement, in three ways to quote."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    doubled = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"
    wide = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '""') + '"'
    out, terms = ["-- a dump; it's one", "/* with ; and ' in\n a comment */;", "CREATE TABLE `te;rm` (`id` int);", "# another; 'comment"], {}
    for i in range(0, rows, 3):
        values = []
        for j in range(i, min(i + 3, rows)):
            terms[j] = f"{NAMES[j % len(NAMES)]} {j}" if j % 2 else NAMES[j % len(NAMES)]
            values.append(f"({j},{(quoted, doubled, wide)[j % 3](terms[j])},'t','GO:{j:07d}', 0 ,0,NULL)")
        out.append(("INSERT INTO `term` VALUES " if i % 2 else "insert into term values\n") + (",\n" if i % 4 else ",").join(values) + ";" + (" -- done; 'yes" if i % 5 == 0 else ""))
    return "\n".join(out) + "\n", terms


@pytest.mark.parametrize("split", ["150", "10000000"])
def test_dump_values_across_splits(spark, tmp_path, split):
    text, terms = dump_text(90)
    (tmp_path / "d.sql").write_text(text)
    (tmp_path / "e.sql").write_text("INSERT INTO `term_subset` VALUES (1,2),(3,4)\n;\nUNLOCK TABLES;")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        t = dumps.read_dump(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["id"]: r["name"] for r in t["term"].collect()} == terms and t["term"].where("is_relation IS NOT NULL").count() == 0
    assert sorted(tuple(r) for r in t["term_subset"].collect()) == [(1, 2), (3, 4)]


@pytest.mark.parametrize("text", ["(1,2),(3", "(1,2) (3,4)", "(1,2), x", "", "(1 2)", "(1,2),", "(1,,2)", "(1,'a''"])
def test_rows_that_cannot_be_read(text):
    with pytest.raises(ValueError):
        dumps.rows_of(f"INSERT INTO `term_subset` VALUES {text}")
    assert dumps.rows_of("INSERT INTO `t` (a, b) VALUES (1,'x'),(NULL, \"y\")") == ("t", [["1", "x"], [None, "y"]])
    assert dumps.rows_of("LOCK TABLES `t` WRITE") is None


@pytest.mark.parametrize("text", ["INSERT INTO `term` VALUES (1,'a);\n", "INSERT INTO `term_subset` VALUES (1,2)", "INSERT INTO `term_subset` VALUES (1,2,3);\n", "INSERT `term_subset` SET a=1;\n"])
def test_broken_dumps_are_errors(spark, tmp_path, text):
    (tmp_path / "d.sql").write_text("INSERT INTO `term_subset` VALUES (7,8);\n" + text)
    with pytest.raises(Exception, match="statement 2|has other than 2 values"):
        dumps.read_dump(spark, str(tmp_path / "d.sql"))["term_subset"].collect()


def test_pieces_of_lines_do_not_depend_on_the_cut():
    """Lines one by one, from the state that the line before leaves, give what a scan of the whole text gives."""
    text, _ = dump_text(60)
    state, found, open_ = dumps.OUTSIDE, [], ""
    for line in text.split("\n"):
        parts, state = dumps.pieces(line, state)
        for part in parts[:-1]:
            found.append(open_ + part)
            open_ = ""
        open_ += parts[-1] + "\n"
    rows = [r for s in found for r in (dumps.rows_of(s) or ("", []))[1]]
    assert [int(r[0]) for r in rows] == list(range(60)) and state == dumps.OUTSIDE and not open_.strip()


def test_streamed_fastq(spark, files, tmp_path):
    """A stream of files gives the reads that a batch gives; blank lines at the end are none, a broken record is an error."""
    d, seqs = files
    (tmp_path / "in").mkdir()
    text = (d / "a.fastq").read_text()
    (tmp_path / "in" / "a.fastq").write_text(text + "\n\n")
    with gzip.open(tmp_path / "in" / "b.fastq.gz", "wt") as f:
        f.write(text.replace("@r", "@s").replace("\n", "\r\n"))
    (tmp_path / "in" / "empty.fastq").write_text("")

    def all_of(name):
        run = sequences.stream_fastq(spark, str(tmp_path / "in"), 1).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        run.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).select("header", "seq", "qual").collect())

    wanted = sorted(tuple(r) for r in sequences.read_fastq(spark, str(d / "a.fastq")).select("header", "seq", "qual").collect())
    assert all_of("out") == sorted(wanted + [("s" + h[1:], s, q) for h, s, q in wanted])
    (tmp_path / "in" / "c.fastq").write_text("@x\nAC\n+\n")
    with pytest.raises(Exception, match="missing quality"):
        all_of("again")


def test_streamed_hits(spark, tmp_path):
    from rarespan.operators import mating_kmer, reads
    from rarespan.streaming import kmers

    rows = spark.createDataFrame([(i, f"h{i}", s, None) for i, s in enumerate(("ACGTA", "TACGT", "GGGGG"))], "read_id long, header string, seq string, qual string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = reads.kmer_queries(rows, 4)
    run = kmers.start(kmers.hits(kmers.read_stream(spark, str(tmp_path / "in"), per_trigger=1), q, 4), "hits", str(tmp_path / "cp"))
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("hits").select(sequence.kmer_code(F.col("kmer")), "n").collect()} == {tuple(r) for r in mating_kmer.counts(q, rows, 4).collect()}


def test_numbers_of_curve_files(spark):
    """Numbers in the middle of two go to the even one, as C's printf has it; half up only if asked for."""
    values = [1 / 64, 3 / 64, 0.5, 5e-6, 1 / 320, 0.0, 1.0, 1 / 3]
    rows = spark.createDataFrame([(i, 0.7, v, v, v, v, v) for i, v in enumerate(values)], "portion_idx int, portion double, avg double, sd double, q1 double, q2 double, q3 double")
    lines = lambda half_up, total: [r["value"] for r in sinks.curve_lines(rows, total, half_up=half_up).orderBy("portion_idx").collect()]
    assert lines(False, 15) == ["\t".join(["%.0f" % (0.7 * 15), *["%.5f" % v] * 5]) for v in values]
    assert lines(False, 15)[0].split("\t")[:2] == ["10", "0.01562"] and lines(True, 15)[0].split("\t")[:2] == ["11", "0.01563"]
    runs = spark.createDataFrame([(0, 0.125, 1, 1 / 2048)], "portion_idx int, portion double, replicate int, redundancy double")
    assert sinks.replicate_lines(runs).head()["value"] == "%.2f\t%d\t%.10f" % (0.125, 1, 1 / 2048) == "0.12\t1\t0.0004882812"


def test_other_sinks(spark, tmp_path):
    r = spark.createDataFrame([(0, 0.001, 1, 0.25)], "portion_idx int, portion double, replicate int, redundancy double")
    sinks.write_replicates(r, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).head()["value"] == "0.00\t1\t0.2500000000"
    c = composition.counts(spark.createDataFrame([(1, "ACGT")], "read_id long, seq string"), 2)
    sinks.save_replicates(r, str(tmp_path / "rt"))
    assert spark.read.parquet(str(tmp_path / "rt")).where("portion_idx = 0").count() == 1
    sinks.write_composition(c, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 3
    sinks.write_fasta(spark.createDataFrame([("h", "AC")], "header string, seq string"), str(tmp_path / "f"))
    assert sequences.read_fasta(spark, str(tmp_path / "f")).select("header", "seq").head() == ("h", "AC")


def test_golden_curves(spark):
    """Three real curves, if RARESPAN_CURVES names a folder that holds them; keyed by their number of reads."""
    folder = Path(os.environ.get("RARESPAN_CURVES", "/nonexistent"))
    paths = sorted(map(str, folder.rglob("*.npo")))
    if len(paths) != 3:
        pytest.skip("RARESPAN_CURVES names no folder with three curves")
    meta, raw = curves.read_metadata(spark, paths), curves.read_points(spark, paths)
    pts = curve.points(raw, meta)
    params = curve.fit(pts, meta)
    rows = curve.summary(pts, meta, params).join(params.select("label", "a", "b"), "label").join(meta.select("label", "R"), "label").collect()
    wanted = {4158944: (0.79021, 0.806352, 17.260378, 54.24362, 3.084731, 0.998624), 13551190: (0.65906, 0.683087, 19.213483, 62.81642, 3.217346, 0.9986215), 206970129: (0.52751, 0.557296, 22.795958, 88.90614, 3.856216, 0.9996735)}
    for x in rows:
        kappa, c, diversity, a, b, r = wanted[x["R"]]
        assert (x["kappa"], x["C"]) == (pytest.approx(kappa), pytest.approx(c, abs=1e-6))
        assert x["diversity"] == pytest.approx(diversity, abs=1e-3) and x["a"] == pytest.approx(a, rel=1e-3) and x["b"] == pytest.approx(b, rel=1e-3)
        assert x["modelR"] == pytest.approx(r, abs=1e-5)
