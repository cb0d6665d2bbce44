import os

from pyspark.sql import functions as F

from clausefold.operators import documents as D
from clausefold.sources import files as SF


def test_label_csv_last_wins_and_short_rows(spark, tmp_dir):
    p = f"{tmp_dir}/clauses.csv"
    open(p, "w").write("0001, None, None, paiement\n0002, False, R9, resiliation\nbad\n0001, False, R12, paiement\n")
    df = SF.read_labels(spark, p, ["invalidity", "policy", "type"])
    got = {r.id: (r.invalidity, r.policy, r.type) for r in df.collect()}
    assert got == {"0001": ("False", "R12", "paiement"), "0002": ("False", "R9", "resiliation")}


def test_label_rows_with_empty_cells_stay(spark, tmp_dir):
    p = f"{tmp_dir}/c.csv"
    open(p, "w").write("0002,,R9,resiliation\n0003,,\n0004\n\n0005, x\n")
    got = {r.id: (r.a, r.b, r.c) for r in SF.read_labels(spark, p, ["a", "b", "c"]).collect()}
    assert got == {"0002": ("", "R9", "resiliation"), "0003": ("", "", ""), "0005": ("x", "", "")}


def test_text_scan_and_semi_join(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/texts")
    for i, t in [("0001_001", "Un."), ("0001_002", "Deux\nlignes."), ("0002_001", "Trois.")]:
        open(f"{tmp_dir}/texts/{i}.txt", "w").write(t)
    ids = spark.createDataFrame([("0001_002",), ("0002_001",)], "id string")
    got = {r.id: r.text for r in SF.read_texts(spark, f"{tmp_dir}/texts", ids).collect()}
    assert got == {"0001_002": "Deux\nlignes.", "0002_001": "Trois."}


def test_encoding_repair(spark, tmp_dir):
    open(f"{tmp_dir}/u.txt", "wb").write("préavis".encode("utf-8"))
    open(f"{tmp_dir}/l.txt", "wb").write("préavis".encode("latin-1"))
    open(f"{tmp_dir}/w.txt", "wb").write(b"l\x92\x9cuvre \x80 5 \x81")
    got = {os.path.basename(r.path): (r.text, r.repaired) for r in SF.read_repaired_texts(spark, tmp_dir).collect()}
    assert got == {"u.txt": ("préavis", False), "l.txt": ("préavis", True), "w.txt": ("l’œuvre € 5 \x81", True)}


def test_listing_and_annotation_outputs(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/c1")
    open(f"{tmp_dir}/c1/a.txt", "w").write("x")
    got = SF.list_clauses(spark, tmp_dir).first()
    assert got.contract == "c1" and got.clause_path.endswith("/c1/a.txt")
    clauses = spark.createDataFrame([(5, "ctr", "Titre, avec virgule", "None")], "clause_no int, contract string, title string, inv string")
    sents = spark.createDataFrame([(5, 1, False, "a", "None"), (5, 2, True, "b", "None")],
                                  "clause_no int, sent_no int, suppressed boolean, text string, sinv string")
    out = SF.annotation_outputs(clauses, sents, ["inv"], ["sinv"])
    assert out["clause_props"].first().title == "Titre  avec virgule"
    assert [r.id for r in out["sentence_texts"].collect()] == ["0005_001"]


def test_contract_roundtrip(spark, tmp_dir):
    clauses = spark.createDataFrame([("c", 1, "T1", "None", "None", "paiement"), ("c", 2, "T2", "False", "R9", ""), ("c", 3, "T3", "None", "None", "")],
                                    "contract string, clause_id long, title string, invalidity string, policies string, type string")
    sents = spark.createDataFrame([(1, 2, "bb", "None", "None"), (1, 1, "a", "None", "None"), (2, 1, "", "x", "y"),
                                   (2, 3, "ccc", "None", "R9")],
                                  "clause_id long, n int, text string, invalidity string, policies string")
    docs = D.nest_contracts(clauses, sents, date="2024-01-01")
    D.write_contracts(docs, f"{tmp_dir}/json")
    back = D.read_contracts(spark, f"{tmp_dir}/json")
    flat = D.flatten_contracts(back).orderBy("clause_pos", "sentence_pos").collect()
    assert [(r.clause_pos, r.sentence_pos, r.position, r.text) for r in flat] == [
        (0, 0, 0, "a"), (0, 1, 2, "bb"), (1, 0, 0, "ccc"), (2, None, None, None)]
    strict = D.flatten_contracts(D.nest_contracts(clauses, sents, date="d", strict_prefix=True)).count()
    assert strict == 4  # two sentences, and the clauses that are left without any
    rows = D.clause_rows(back).orderBy("title").collect()
    assert [r.text for r in rows] == ["a bb ", "ccc ", ""] and rows[1].policies == "R9"


def test_flat_dataset_and_numbered_label_sets(spark, tmp_dir):
    import os
    for k, rows in (("b", "1, x\n2,y\n3,\n"), ("a", "id,label\n7, z\n")):
        os.makedirs(f"{tmp_dir}/{k}/texts")
        open(f"{tmp_dir}/{k}/classes.csv", "w").write(rows)
    for i in (1, 2, 9):
        open(f"{tmp_dir}/b/texts/{i}.txt", "w").write(f"text {i}")
    rows, mismatches = SF.read_flat_dataset(spark, f"{tmp_dir}/b")
    assert {tuple(r) for r in rows.collect()} == {("1", "x", "text 1"), ("2", "y", "text 2")}
    assert {tuple(r) for r in mismatches.collect()} == {("3", "label_only"), ("9", "text_only")}
    many = SF.read_many_label_sets(spark, [f"{tmp_dir}/b", f"{tmp_dir}/a"], "classes.csv", ["label"])
    assert {(r.id, r.label) for r in many.collect()} == {("00001_7", "z"), ("00002_1", "x"), ("00002_2", "y"), ("00002_3", None)}
