import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from dosarium.functions import paths, text, validate
from dosarium.operators import collisions, history, ranking, scan, stores
from dosarium.plans.scan import plan_scan
from dosarium.sources import files as sources
from dosarium.streaming import inbox


def one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_strip_takes_all_white_space(spark):
    values = ["  a\xa0\n", "\x85b　", "", None, " \t", "a b"]
    assert one(spark, values, text.strip) == [v if v is None else v.strip() for v in values]


def test_suffix_and_stem(spark):
    names = ["/d/a.tar.gz", "/d/.bashrc", "/d/noext", "/d/a.", "/d/..x", "/d/a.b", None, ""]
    assert one(spark, names, paths.suffix) == [".gz", "", "", "", ".x", ".b", None, ""]
    assert one(spark, names, paths.stem) == ["a.tar", ".bashrc", "noext", "a.", ".", "a", None, ""]
    assert one(spark, ["/a/b/c.txt", "c", "/c"], paths.parent) == ["/a/b", "", ""]


def test_hidden_by_own_name_only(spark):
    assert one(spark, ["/x/.git/config", "/x/_a.pdf", "/x/.h"], paths.visible) == [True, True, False]


def test_join_and_escape(spark):
    values = [".", "", "/abs", "sub/x", "../y", "a/../../b", "..z"]
    assert one(spark, values, lambda c: paths.join(F.lit("/dest"), c)) == ["/dest", "/dest", "/abs", "/dest/sub/x", "/dest/../y", "/dest/a/../../b", "/dest/..z"]
    assert one(spark, values, paths.escapes) == [False, False, True, False, True, True, False]


def test_descriptive_name(spark):
    wrapped = ["Image Vision Analysis:\nDog Park.jpeg\n\nExtracted OCR Text:\nx", "no marker", "Image Vision Analysis:\nEroare Vision AI: 1", "Image Vision Analysis:\n  \n\nExtracted OCR Text:\ny", "Image Vision Analysis:\nșș\n", "Image Vision Analysis: a Image Vision Analysis: b"]
    named = one(spark, wrapped, lambda c: text.descriptive_name(c, F.lit("o.jpeg"), F.lit(".jpeg")))
    assert named == ["Dog_Parkjpeg.jpeg", "o.jpeg", "o.jpeg", "o.jpeg", "o.jpeg", "a.jpeg"]
    assert one(spark, wrapped[:1], lambda c: text.descriptive_name(c, F.lit("o"), F.lit(""))) == ["Dog_Parkjpeg"]


def test_small_texts(spark):
    assert one(spark, ["😀" * 300, "", None], lambda c: F.length(text.technical_summary(c))) == [200, 0, None]
    assert one(spark, ["", None, "x"], text.null_display) == ["—", "—", "x"]
    assert one(spark, ["", None, " "], text.content_or_default) == [text.EMPTY_CONTENT, text.EMPTY_CONTENT, " "]
    assert one(spark, [" a\\nb\nc "], text.log_cleanup) == ["a<br>b\nc"]
    assert one(spark, ["Eroare: succes", "lipsă", "Skip", "VISION", "x", " ", None], text.log_severity) == ["success", "error", "warning", "process", "default", None, None]
    assert one(spark, ['a<b>:"c/d\\e|f?g*h'], text.sanitise) == ["a_b___c_d_e_f_g_h"]
    assert one(spark, ["a.PDF", "a"], lambda c: paths.append_suffix(c, F.lit(".pdf"))) == ["a.PDF", "a.pdf"]
    assert one(spark, ["```json\n{}\n```", "{}"], text.strip_fences) == ["{}", "{}"]
    got = spark.range(1).select(text.progress(F.lit(29), F.lit(100)), text.progress(F.lit(1), F.lit(0))).first()
    assert tuple(got) == (28, None)


def test_rules(spark):
    assert one(spark, ["any", " ALL\n", "\xa0Any", "Toate fișierele", None], scan.bypasses) == [True, True, True, False, None]
    assert one(spark, ["", " descriptive_name_based_on_content ", "{original_filename}", "[An]", None], scan.naming_mode) == ["descriptive", "descriptive", "original", "template", None]
    assert one(spark, ["Any", "", " x ", "all "], lambda c: paths.folder_or_default(c, text.strip(c))) == ["Organized", "Organized", " x ", "Organized"]


def test_route_errors(spark):
    rows = [("move", "n", "f"), ("move", None, "f"), ("move", "n", None), ("quarantine", None, None), ("quarantine", "n", "weird"), ("delete", "n", "f"), (None, "n", "f")]
    df = spark.createDataFrame(rows, "status string, suggested_name string, suggested_folder string")
    got = [(r["outcome"], r["target_folder"]) for r in scan.route(df).collect()]
    assert got == [("move", "f"), ("error", None), ("error", None), ("error", None), ("quarantine", "Quarantine"), ("error", None), ("error", None)]


@pytest.mark.parametrize(
    "answer, valid",
    [('{"document_type": "a"}', True), ('```json\n{"summary": ""}\n```', True), ("{'a': 1}", False), ('{"a": 1} x', False), ('{"entities": null}', False), ("[1]", False), ('{"summary": "%s"}' % ("x" * 501), False), ('{"summary": null}', False), ('{"document_type": 1}', False), ("```{}```", False), ("", False), (None, False)]
    + [('{"entities": [{"field_name": "a", "value": %s}]}' % v, ok) for v, ok in (("null", True), ('1, "confidence": "0.9"', True), ('1, "confidence": true', True), ('1, "confidence": null', False), ('1, "confidence": 1.5', False), ('1, "confidence": NaN', False))]
    + [('{"entities": [{"field_name": "a"}]}', False)],
)
def test_extraction_answers(answer, valid):
    got = validate._safe(validate.read_extraction, 5)(answer)
    assert (got[-1] is None) == valid


def test_decision_and_rule_answers(spark):
    df = spark.createDataFrame([('{"status": "move", "suggested_name": "a/b:c"}', '{"category": "x", "folder_structure": "."}'), ('{"status": "delete"}', '{"category": 1}')], "d string, r string")
    rows = df.select(validate.parse_decision("d").alias("d"), validate.parse_rule("r").alias("r")).collect()
    assert rows[0]["d"]["suggested_name"] == "a_b_c" and rows[0]["r"]["naming_convention"] == "{original_filename}"
    assert rows[1]["d"]["error"] and rows[1]["r"]["error"]


def test_model_is_asked_again(spark):
    def model(prompt):
        return "no" if "Invalid" not in prompt else '{"status": "quarantine", "suggested_name": "n"}'

    got = spark.createDataFrame([("p",)], "p string").select(validate.ask(model, F.col("p"), validate.DECISION).alias("d")).first()["d"]
    assert got["status"] == "quarantine" and got["error"] is None

    def refused(prompt):
        raise RuntimeError("429")

    got = spark.createDataFrame([("p",)], "p string").select(validate.ask(refused, F.col("p"), validate.DECISION).alias("d")).first()["d"]
    assert got["error"] == "429"


def test_anti_join_stands_below_the_reader(spark, tmp_path):
    files = spark.createDataFrame([("/a/x.txt",)], "path string")
    files = files.select("path", paths.name(F.col("path")).alias("name"), paths.suffix(F.col("path")).alias("suffix"), paths.kind(F.col("path")).alias("kind"))
    reviewed = spark.createDataFrame([("/b",)], "original_path string")
    plan = sources.with_content(scan.new_files(files, reviewed))._jdf.queryExecution().executedPlan().toString()
    # The plan prints from the top down: below every reader stands an anti-join.
    assert "ArrowEvalPython" in plan and all("LeftAnti" in part for part in plan.split("ArrowEvalPython"))


def test_quarantine_store(spark, tmp_path):
    s = stores.QuarantineStore(spark, f"file://{tmp_path}/q")
    assert [s.add(f"/p{i}", "n", "f", "r") for i in range(3)] == [1, 2, 3]
    assert s.get_by_id(2)["original_path"] == "/p1" and s.get_by_id(999) is None
    assert s.update(2, ai_proposed_name="m", reason="") and s.get_by_id(2)["ai_proposed_name"] == "m" and s.get_by_id(2)["reason"] == ""
    assert not s.update(2) and not s.update(999, reason="x")
    assert s.remove(1) and not s.remove(1)
    again = stores.QuarantineStore(spark, f"file://{tmp_path}/q")
    assert [r["id"] for r in again.get_all().collect()] == [2, 3]
    assert again.clear_all() == 2 and again.clear_all() == 0 and again.current().isEmpty()
    assert again.add("/z", "n", "f") == 4
    with pytest.raises(ValueError):
        again.add("/z", None, "f")
    again.append_all(spark.createDataFrame([("/u", "n", "f", None, 2), ("/t", "n", "f", None, 1)], "original_path string, ai_proposed_name string, ai_proposed_folder string, reason string, order int"))
    assert [(r["id"], r["original_path"]) for r in again.get_all().collect()] == [(4, "/z"), (5, "/t"), (6, "/u")]


def test_rule_store(spark, tmp_path):
    s = stores.RuleStore(spark, f"file://{tmp_path}/r")
    s.seed()
    s.seed()
    assert [r["name"] for r in s.get_all_rules().collect()] == [s.DEFAULT[0]]
    first = s.save_rule("a", "q", "", "[An]")
    second = s.save_rule("a", "q2", "", "[An]")
    assert second > first and s.get_rule_by_name("a")["query"] == "q2" and s.get_rule_by_name("A") is None
    assert s.delete_rule("a") and s.delete_rule("a") and s.get_rule_by_name("a") is None


def test_fold_clear_and_readd(spark):
    rows = [(1, "add", 1, "a"), (2, "update", 1, "b"), (3, "clear", None, None), (4, "update", 1, "c"), (5, "add", 2, "d"), (6, "remove", 2, None), (7, "add", 2, "e"), (8, "update", 2, None)]
    log = spark.createDataFrame(rows, "seq long, op string, id long, v string")
    assert [(r["id"], r["v"]) for r in stores.fold(log, "id", ["v"]).collect()] == [(2, "e")]
    assert stores.fold(log.limit(0), "id", ["v"]).isEmpty()


def test_ranked_numbers_a_hot_key_over_partitions(spark):
    rows = [("hot", i) for i in range(400)] + [(None, 1), (None, 2), ("b", 7)]
    random.Random(1).shuffle(rows)
    got = ranking.ranked(spark.createDataFrame(rows, "k string, o int").repartition(4), ["k"], ["o"]).collect()
    assert len(got) == len(rows)
    assert all(r["rank"] == (r["o"] + 1 if r["k"] == "hot" else r["o"] if r["k"] is None else 1) for r in got)


def greedy(names, existing):
    used, out = set(existing), []
    for n in names:
        stem, dot, end = n.rpartition(".")
        stem, end = (stem, "." + end) if dot and stem and end else (n, "")
        target, k = n, 1
        while target in used:
            target, k = f"{stem}_{k}{end}", k + 1
        used.add(target)
        out.append(target)
    return out


def test_collisions_against_brute_force(spark):
    pool = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "b", "b_1", "c.x"]
    rnd = random.Random(3)
    moves, there, expect = [], [], {}
    for case in range(60):
        names = [rnd.choice(pool) for _ in range(rnd.randint(1, 8))]
        held = rnd.sample(pool, rnd.randint(0, 2))
        folder = f"f{case}"
        moves += [(f"{folder}/{i:03}", folder, n) for i, n in enumerate(names)]
        there += [(folder, n) for n in held]
        expect |= {f"{folder}/{i:03}": t for i, t in enumerate(greedy(names, held))}
    moves += [("x", None, "n"), ("y", "f", None)]
    plan = collisions.plan_targets(spark.createDataFrame(moves, "path string, folder string, name string"), spark.createDataFrame(there, "folder string, name string"))
    assert {r["path"]: r["target"] for r in plan.collect()} == expect


def test_newest_fifty(spark):
    rows = [("a", i) for i in range(80)] + [("b", 1)]
    got = history.newest(spark.createDataFrame(rows, "k string, t int"), ["k"], ["t"]).collect()
    assert len(got) == 51 and min(r["t"] for r in got if r["k"] == "a") == 30


def test_undo(tmp_path):
    log = history.MoveLog(3)
    assert log.get_history() == [] and not log.undo_last_action() and not log.undo_action(0) and not log.undo_action(-1)
    files = []
    for i in range(5):
        f = tmp_path / "in" / f"{i}.txt"
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(bytes([i]) * 1024)
        files.append(history.move_and_rename(f, tmp_path / "out", "same.txt", log))
    assert [f.name for f in files] == ["same.txt", "same_1.txt", "same_2.txt", "same_3.txt", "same_4.txt"]
    assert len(log.get_history()) == 3
    (tmp_path / "in").rmdir()
    assert log.undo_action(0) and (tmp_path / "in" / "2.txt").read_bytes() == b"\x02" * 1024
    files[3].unlink()
    assert not log.undo_action(0) and len(log.get_history()) == 2
    assert log.undo_last_action() and len(log.get_history()) == 1
    assert not log.undo_last_action() and log.get_history() == []
    with pytest.raises(FileNotFoundError):
        history.move_and_rename(tmp_path / "in", tmp_path / "out", "d")


def test_moves_out_of_the_destination_are_refused(tmp_path):
    source = tmp_path / "a.txt"
    source.write_text("x")
    log = history.MoveLog()
    plan = [{"path": str(source), "folder": f, "name": n} for f, n in (("../y", "a.txt"), ("/tmp", "a.txt"), ("ok", "../a.txt"), ("ok", "b.txt"))]
    done = history.apply_moves(plan, tmp_path / "dest", log)
    assert [bool(e) for _, _, e in done] == [True, True, True, False] and (tmp_path / "dest/ok/b.txt").exists()


def test_scan_of_a_folder(spark, tmp_path):
    root = tmp_path / "inbox"
    (root / ".git").mkdir(parents=True)
    for name in ("a.txt", ".hidden", ".git/config", "_b.md", "c.xyz", "old.csv"):
        (root / name).write_text(f"text of {name}")
    with zipfile.ZipFile(root / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    files = sources.list_files(spark, str(root))
    content = {r["name"]: r["content"] for r in sources.with_content(files).collect()}
    assert content == {"a.txt": "text of a.txt", "config": "Fișier de tip necunoscut (). Conținut text nedisponibil.", "_b.md": "text of _b.md", "c.xyz": "Fișier de tip necunoscut (.xyz). Conținut text nedisponibil.", "old.csv": "text of old.csv", "d.docx": "one\ntwo"}
    reviewed = spark.createDataFrame([(str(root / "old.csv"),)], "original_path string")
    rule = spark.createDataFrame([("invoices", ".", "[An]")], "category string, folder_structure string, naming_convention string")
    plan = {r["name"]: r["outcome"] for r in plan_scan(files, reviewed, rule).collect()}
    assert plan == dict.fromkeys(["a.txt", "config", "_b.md", "c.xyz", "d.docx"], "quarantine")
    everything = spark.createDataFrame([(" ANY ", "all", "descriptive_name_based_on_content")], rule.schema)

    def extractor(prompt):
        return '{"suggested_filename": "same name"}' if "a.txt" in prompt or "_b" in prompt else "broken"

    moved = {r["name"]: (r["target"], r["target_folder"]) for r in plan_scan(files, reviewed, everything, extractor).collect()}
    assert moved["a.txt"] == ("same name.txt", "Organized") and moved["_b.md"] == ("same name.md", "Organized") and moved["c.xyz"] == ("c.xyz", "Organized")
    with pytest.raises(LookupError):
        plan_scan(files, reviewed, rule.limit(0))
    with pytest.raises(ValueError):
        scan.apply_rule(files, rule.union(rule))


def test_listing_of_an_empty_folder(spark, tmp_path):
    assert sources.list_files(spark, str(tmp_path)).isEmpty()


def test_stream(spark, tmp_path):
    rows = [("/a/x.pdf", "2024-01-01 00:00:00"), ("/a/.h", "2024-01-01 01:00:00"), ("/a/y.png", "2024-01-01 02:00:00"), ("/a/x.pdf", "2024-01-01 03:00:00")]
    spark.createDataFrame(rows, "original_path string, t string").select("original_path", F.to_timestamp("t").alias("at")).write.parquet(f"file://{tmp_path}/in")
    stream = inbox.inbox_stream(spark, f"file://{tmp_path}/in", "original_path string, at timestamp")
    seen = []
    query = inbox.run_batches(inbox.first_arrivals(stream, "original_path", "at", "1 day"), lambda df, _: seen.extend(r["name"] for r in df.collect()), f"{tmp_path}/cp")
    query.awaitTermination(60)
    assert sorted(seen) == ["x.pdf", "y.png"]


def test_queries_have_sql_or_a_test():
    from dosarium.plans import catalogue

    assert set(catalogue.oracle_sql()) == set(catalogue.queries()) - {"collision_plan_hard"}
    assert catalogue.FLAGSHIP in catalogue.queries()
    assert len(list(itertools.chain(catalogue.queries()))) > 30
