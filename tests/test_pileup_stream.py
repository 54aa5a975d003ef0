import random

from pyspark.sql import functions as F

from locusforge.functions.pileup import clean_bases
from locusforge.sources import io
from locusforge.streaming import ingest


def by_characters(text):
    """The pileup format read one character at a time: ``^`` makes the next character a mapping quality, ``$`` ends a read, a sign
    before digits announces so many inserted or deleted bases; whatever else stands there is a base."""
    kept, state, pending, left = [], "base", "", 0
    for c in text:
        if state == "quality":
            state = "base"
            continue
        if state == "skip":
            left -= 1
            state = "skip" if left else "base"
            continue
        if state == "number":
            if c in "0123456789":
                pending += c
                continue
            if len(pending) == 1:  # a sign without a number is no indel
                kept.append(pending)
                state = "base"
            else:
                left = int(pending[1:])
                state = "skip" if left else "base"
                if left:
                    left -= 1
                    state = "skip" if left else "base"
                    continue
        if c == "^":
            state = "quality"
        elif c in "+-":
            state, pending = "number", c
        elif c != "$":
            kept.append(c.upper())
    if state == "number" and len(pending) == 1:
        kept.append(pending)
    if state == "quality":
        kept.append("^")  # nothing follows it
    return "".join(kept)


#: Text and what is left of it, by hand.
CASES = {
    "": "", "AcGt.,*N": "ACGT.,*N", "^]A": "A", "^$A": "A", "^+A": "A", "^-3ACG": "3ACG", "+2ACg": "G", "-12ACGTACGTACGTa": "A", "A+1": "A", "A+9AC": "A", "^": "^", "A^": "A^", "$$": "",
    "+70" + "A" * 75 + "c": "AAAAAC", "-007ACGTACGT": "T", "+100A": "", "a+1C+1Ct": "AT", "+61" + "C" * 61 + "g": "G", "+60" + "C" * 60 + "g": "G", "^^^A$": "", "+3A$C^xT": "T", "+0A": "A", "-A": "-A", "+": "+",
}


def test_the_format_by_hand(spark):
    df = spark.createDataFrame(list(CASES.items()), "t string, want string")
    assert [tuple(r) for r in df.select("t", clean_bases("t").alias("got"), "want").where("got <> want").collect()] == []
    assert {t: by_characters(t) for t in CASES} == CASES


def test_cleaning_matches_a_reading_by_characters(spark):
    r = random.Random(5)
    texts = [*CASES] + ["".join(r.choice("ACGTacgt.,*N^$+-0123456]") for _ in range(r.randrange(40))) for _ in range(3000)] + ["".join(r.choice(["A", "g", "^]", "$", "+2AC", "-11ACGTACGTACG", ".", ","]) for _ in range(300)) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_bases("t").alias("c")).collect()}
    assert got[-1] is None
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != by_characters(t)] == []


LINES = ["chr1\t5\tN\t3\tAc^]g\tIII", "chr1\t6\tN\t2\t$T+2aaT", "", "chr1\t7\tN\t0", "chr2\tx\tN\t1\tA", "chr2\t8\tN\t1\t*"]
WANT = {("chr1", 5): (1, 1, 1, 0), ("chr1", 6): (0, 0, 0, 2), ("chr2", 8): (0, 0, 0, 0)}


def counts(df):
    return {(r.chrom, r.pos): (r.A, r.C, r.G, r["T"]) for r in df.collect()}


def test_batch_and_stream_give_the_same(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(LINES))
    assert counts(ingest.pileup_profile(spark.read.text(str(source)))) == WANT
    ranges = spark.createDataFrame([("g", "chr1", 6, 9)], "gene string, scaffold string, start long, end long")
    for name, r in (("plain", None), ("genes", ranges)):
        target, state = str(tmp_path / name), str(tmp_path / f"{name}-state")
        (source / "b.txt").unlink(missing_ok=True)
        for extra in (None, "chr3\t1\tN\t1\tA", None):
            if extra:
                (source / "b.txt").write_text(extra)
            ingest.stream_pileups(spark, str(source), target, state, r).awaitTermination()
        out = io.merge_parquet(spark, target)
        assert counts(out) == WANT | {("chr3", 1): (1, 0, 0, 0)} and out.count() == 4
        assert {x.gene for x in out.where("chrom = 'chr1' and pos = 6").collect()} == {"g" if r is not None else "NA"}


def test_completion_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "done")
    names = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "profile_name string")
    done = spark.createDataFrame([("g", "b", "a")], "genome string, sample_1 string, sample_2 string")
    io.write_parquet(done, path)
    run = lambda pairs: pairs.withColumn("genome", F.lit("g"))
    assert ingest.complete(names, path, run) and not ingest.complete(names, path, run)
    assert sorted((r.sample_1, r.sample_2) for r in spark.read.parquet(path).collect()) == [("a", "c"), ("b", "a"), ("b", "c")]
