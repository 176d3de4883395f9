import math
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import models
from kinset import (
    collect_group_columns,
    collect_groups,
    distance,
    from_json_records,
    group_sizes,
    hamming_norm,
    parse_grouped,
    parse_record,
    read_annotated,
    read_fasta,
    read_grouped,
    split_rejects,
    to_json_records,
    top_groups,
    with_ordinal,
    with_record,
    write_clusters,
    write_labels,
)
from kinset.operators.joins import attach
from kinset.sources.readers import as_sequences

LG = ["V_CALL", "J_CALL", "JUNCTION_LENGTH"]


def put(path, text):
    path.write_text(text)
    return str(path)


def one(df):
    return df.collect()[0][0]


def test_distances(spark):
    words = ["", "A", "ACGT", "TTTT", "kitten", "sitting", "AC"]
    rows = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", distance("edit", "a", "b").alias("d")).collect():
        assert r.d == models.edit(r.a, r.b)
    same = df.where("length(a) = length(b)").select("a", "b", distance("hamming", "a", "b").alias("d"))
    for r in same.collect():
        assert r.d == models.hamming(r.a, r.b) or (r.a == "" and math.isnan(r.d))
    with pytest.raises(PySparkException, match="equal length"):
        df.select(hamming_norm("a", "b")).collect()
    nulls = spark.createDataFrame([(None, "A")], "a string, b string")
    assert one(nulls.select(hamming_norm("a", "b"))) is None
    with pytest.raises(ValueError):
        distance("cosine", "a", "b")


def test_records(spark):
    df = spark.createDataFrame([(1, "x", "ACGT")], "Index long, SEQUENCE_ID string, JUNCTION string")
    assert with_record(df).select("Seq.JUNCTION").first()[0] == "ACGT"
    text = spark.createDataFrame([("[7,lab,ACG]",), ("[x,lab]",)], "t string")
    good = text.where("t like '[7%'").select(parse_record("t").alias("r")).first().r
    assert (good.id, good.label, good.seq) == (7, "lab", "ACG")
    with pytest.raises(PySparkException):
        text.select(parse_record("t")).collect()
    bad = text.select(parse_record("t", "reject").alias("r")).collect()[1].r
    assert (bad.id, bad.seq) == (None, None)
    js = spark.createDataFrame(
        [('{"id":1.0,"label":"a","seq":"AC"}',), ('{"id":1,"label":"a","seq":"AC"}',)], "j string"
    )
    assert {tuple(r.r) for r in js.select(from_json_records("j").alias("r")).collect()} == {
        (1, "a", "AC")
    }
    rec = spark.createDataFrame([(-1, "label1", "ACGT")], "id long, label string, seq string")
    assert one(rec.select(to_json_records())) == '{"id":-1,"label":"label1","seq":"ACGT"}'


def test_annotated(spark, tmp_path):
    path = put(
        tmp_path / "a.tsv",
        "Index\tID\tV_CALL\tJ_CALL\tJUNCTION_LENGTH\tJUNCTION\tmore\n"
        "0\ts,0\tV1\tJ1\t4\tACGT\tx\n1\ts1\tV1\tJ1\t4\t\tx\nbad\ts2\tV2\tJ1\t3\tACG\tx\n",
    )
    df = read_annotated(spark, path, {"ID": "SEQUENCE_ID"})
    assert dict(df.dtypes)["JUNCTION_LENGTH"] == "int" and dict(df.dtypes)["Index"] == "bigint"
    good, rejected = split_rejects(as_sequences(df))
    # A comma in an id does not move the fields.
    assert [(r.id, r.label, r.seq) for r in good.collect()] == [(0, "s,0", "ACGT")]
    assert rejected.count() == 2
    assert set(dict(read_annotated(spark, path, {"ID": "SEQUENCE_ID"}, typed=False).dtypes).values()) == {
        "string"
    }


def test_grouped(spark, tmp_path):
    head = "gid\trecord\n"
    body = '1\t"0,a,ACGT"\n1\t"1,b,ACGA,extra"\n'
    put(tmp_path / "x.tsv", head + body + head + '2\t"2,c,AC"\n')
    put(tmp_path / "y.tsv", head + '3\t"3,d,AA"\n')
    df = read_grouped(spark, str(tmp_path), p=5)
    assert df.rdd.getNumPartitions() >= 5
    assert sorted(tuple(r) for r in df.collect()) == [
        (1, 0, "a", "ACGT"), (1, 1, "b", "ACGA"), (2, 2, "c", "AC"), (3, 3, "d", "AA"),
    ]
    broken = put(tmp_path / "z.tsv", head + '4\t"no,e,AA"\n5\t"6,f"\n7\t"7,g,AC"\n')
    with pytest.raises(PySparkException):
        read_grouped(spark, broken).collect()
    good, rejected = split_rejects(read_grouped(spark, broken, on_error="reject"))
    assert [r.id for r in good.collect()] == [7] and rejected.count() == 2
    # A line without a record, and a number out of range.
    for line in ("2", '3000000000\t"1,a,AC"'):
        bad = spark.createDataFrame([(line,), ('7\t"7,g,AC"',)], "value string")
        with pytest.raises(PySparkException):
            parse_grouped(bad).collect()
        good, rejected = split_rejects(parse_grouped(bad, on_error="reject"))
        assert [r.id for r in good.collect()] == [7] and rejected.count() == 1


def test_fasta(spark, tmp_path):
    path = put(tmp_path / "s.fasta", ">one a>b\nACGT\n>two\r\nAC\r\nGT\n>three\nA\n>tail\n")
    got = [(r.id, r.label, r.seq) for r in read_fasta(spark, path).orderBy("id").collect()]
    assert got == [(0, "one a>b", "ACGT"), (1, "two", "ACGT"), (2, "three", "A"), (3, "tail", None)]
    odd = read_fasta(spark, path, keep_marker=True, odd_tail="repeat").orderBy("id").collect()
    assert (odd[0].label, odd[3].label, odd[3].seq) == (">one a>b", ">tail", ">tail")
    long = put(tmp_path / "l.fasta", "".join(f">r{i}\nAC\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = read_fasta(spark, long).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.id: r.label for r in rows} == {i: f"r{i}" for i in range(500)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(50)], "id long, label long")
    out = str(tmp_path / "labels")
    write_labels(df.repartition(4), out)
    lines = []
    for name in sorted(n for n in os.listdir(out) if n.startswith("part-")):
        lines += open(os.path.join(out, name)).read().split()
    assert lines == [str((i * 7) % 5) for i in range(50)]
    for kind in ("parquet", "json", "text"):
        path = str(tmp_path / kind)
        write_clusters(df, path, kind)
        assert spark.read.format(kind).load(path).count() == 50
        with pytest.raises(PySparkException):
            write_clusters(df, path, kind)
    with pytest.raises(ValueError):
        write_clusters(df, out, "orc")


def test_groups(spark):
    rows = [(g, i, f"s{i}") for i, g in enumerate("aaaaabbbccd")] + [(None, 90, "n"), (None, 91, "m")]
    df = spark.createDataFrame(rows, "g string, id long, seq string").repartition(3)
    sizes = {r.g: r.n for r in group_sizes(df, ["g"]).collect()}
    assert sizes == {"a": 5, "b": 3, "c": 2, "d": 1, None: 2}
    assert [r.g for r in top_groups(df, ["g"], 3).collect()] == ["a", "b", None]
    # Fewer groups than asked for.
    assert top_groups(df, ["g"], 10).count() == 5
    lists = collect_groups(df, ["g"], ["id", "seq"], list_rows=2).collect()
    got = {}
    for r in sorted(lists, key=lambda r: (r.g or "", r.part)):
        assert len(r.SeqList) <= 2
        got.setdefault(r.g, []).extend((x.id, x.seq) for x in r.SeqList)
    assert got == {g: [(i, s) for h, i, s in rows if h == g] for g in sizes}
    pair = collect_group_columns(df, ["g"], {"id": "ids", "seq": "seqs"}, list_rows=5).where("g = 'a'").first()
    assert pair.ids == [0, 1, 2, 3, 4] and pair.seqs == [f"s{i}" for i in range(5)] and pair.part == 0
    numbers = with_ordinal(df, ["id"], ["g"]).collect()
    assert all(
        r.ordinal == sum(1 for h, i, _ in rows if h == r.g and i < r.id) for r in numbers
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_splits_hot_keys(spark, skewed, how):
    fact = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(60)], "k long, v long")
    dim = spark.createDataFrame([(i, f"d{i}") for i in range(0, 40)], "k long, d string")
    got = attach(fact, dim, ["k"], 60, how)
    want = fact.join(dim, "k", how)
    assert sorted(map(str, got.select("k", "v", "d").collect())) == sorted(
        map(str, want.select("k", "v", "d").collect())
    )


def test_grouped_header_is_in_the_first_file_not_the_largest(spark, tmp_path):
    put(tmp_path / "a.txt", 'gid\trecord\n1\t"0,a,ACGT"\n')
    put(tmp_path / "b.txt", "".join(f'2\t"{i},b,ACGA"\n' for i in range(1, 40)))
    assert sorted(r.id for r in read_grouped(spark, str(tmp_path), p=4).collect()) == list(range(40))
