import random
import re

import pytest
from pyspark.sql import functions as F

from dosarium.functions import text, validate
from dosarium.operators import collisions, history, review, scan, stores
from dosarium.plans import scan as plans
from dosarium.sources import files as sources


def greedy(moves, there):
    """The rule as it is stated, one file after the other."""
    used, out = {f: set() for f, _ in there} | {f: set() for _, f, _ in moves}, {}
    for f, n in there:
        used[f].add(n)
    for path, folder, name in sorted(moves):
        cut = re.match(r"(?s)^(.+)(\.[^.]+)$", name)
        stem, suffix = (cut[1], cut[2]) if cut else (name, "")
        target, n = name, 1
        while target in used[folder]:
            target, n = f"{stem}_{n}{suffix}", n + 1
        used[folder].add(target)
        out[path] = target
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_numbered_names_against_the_greedy_rule(spark, seed):
    rnd = random.Random(seed)
    names = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "a_2_1.txt", "a_01.txt", "a_3.txt", "a_5.txt", "a_1_2.txt", "b", "b_1", "_1.x", ".x", ".x_1", "a.b_1.c", "a.b.c", "c_1_1_1.d", "c_1_1.d", "c_1.d", "c.d", "x_0.y", "x.y"]
    picked = rnd.sample(names, 9) + ["a.txt"]
    moves = [(f"{i:05d}", rnd.choice(["f", "g"]), rnd.choice(picked)) for i in range(150)]
    there = [(rnd.choice(["f", "g", "h"]), rnd.choice(names)) for _ in range(rnd.choice([0, 6]))]
    got = collisions.plan_targets(spark.createDataFrame([*moves, ("x", None, "a"), ("y", "f", None)], "path string, folder string, name string"), spark.createDataFrame([*there, (None, "a.txt")], "folder string, name string"))
    assert {r["path"]: r["target"] for r in got.collect()} == greedy(moves, there)


def test_targets_of_a_hot_name_and_of_nothing(spark):
    moves = spark.range(3000).select(F.format_string("%06d", "id").alias("path"), F.lit("f").alias("folder"), F.when(F.col("id") == 1500, "scan_7.pdf").when(F.col("id") == 3, "scan_2000.pdf").otherwise("scan.pdf").alias("name"))
    got = {r["path"]: r["target"] for r in collisions.plan_targets(moves).collect()}
    assert got == greedy([tuple(r) for r in moves.collect()], []) and len(set(got.values())) == 3000
    assert collisions.plan_targets(moves.limit(0)).isEmpty()


def test_approve_and_reject(spark, tmp_path):
    store, log = stores.QuarantineStore(spark, f"file://{tmp_path}/store"), history.MoveLog()
    (tmp_path / "in").mkdir()
    for n in ("a.txt", "b.txt", "c.txt"):
        (tmp_path / "in" / n).write_text(n)
    keys = [store.add(f"{tmp_path}/in/{n}", n, "Quarantine", None) for n in ("a.txt", "b.txt", "c.txt", "gone.txt")]
    assert review.approve(store, keys[0], " ", "x", log) == "incomplete" and store.get_by_id(keys[0])
    assert review.approve(store, keys[0], " new.txt ", f"{tmp_path}/out", log) == "moved" and (tmp_path / "out/new.txt").read_text() == "a.txt"
    assert review.approve(store, keys[1], "new.txt", f"{tmp_path}/out", log) == "moved" and (tmp_path / "out/new_1.txt").exists()
    assert review.approve(store, keys[3], "x.txt", f"{tmp_path}/out", log) == "vanished" and store.get_by_id(keys[3]) is None
    assert review.reject(store, keys[2]) and (tmp_path / "in/c.txt").exists() and not review.reject(store, keys[2])
    assert review.approve(store, 99, "x", "y", log) == "unknown" and store.get_all().isEmpty()
    assert log.undo_last_action() and (tmp_path / "in/b.txt").exists()
    # An error other than a missing source leaves the row.
    key = store.add(f"{tmp_path}/in/b.txt", "b", "q")
    (tmp_path / "file").write_text("")
    assert "Error" in review.approve(store, key, "b", f"{tmp_path}/file/sub", log) and store.get_by_id(key)


def test_approvals_of_nulls_and_clashing_columns(spark):
    reviewed = spark.createDataFrame([(1, "/a", "x"), (2, "/b", "y"), (3, None, "z")], "id long, original_path string, name string")
    edits = spark.createDataFrame([(1, " n ", "f", "k"), (2, "n", None, "k"), (3, "n", "f", "k"), (9, "n", "f", "k")], "id long, name string, folder string, path string")
    there = spark.createDataFrame([("/a", 1), ("/a", 2), (None, 3)], "path string, id int")
    got = {r["id"]: (r["name"], r["outcome"], r["removed"]) for r in review.approvals(reviewed, edits, there).collect()}
    assert got == {1: ("n", "move", True), 2: ("n", "incomplete", False), 3: ("n", "vanished", True)}
    assert review.approvals(reviewed.limit(0), edits, there).isEmpty()
    assert {r["id"] for r in review.remaining(reviewed, edits.where("id < 3")).collect()} == {3}


def test_store_compaction_keeps_rows_and_never_gives_an_id_again(spark, tmp_path):
    store = stores.QuarantineStore(spark, f"file://{tmp_path}/store")
    keys = [store.add(f"/{i}", "n", "f", "") for i in range(4)]
    store.update(keys[0], reason="why")
    store.remove(keys[3])
    before = store.get_all().collect()
    store.compact()
    assert store.get_all().collect() == before and len(store._listed()) <= 8
    again = stores.QuarantineStore(spark, f"file://{tmp_path}/store")
    assert again.get_all().collect() == before and again.add("/x", "n", "f") == 5
    assert again.clear_all() == 4 and again.add("/y", "n", "f") == 6


def test_undo_over_tables(spark):
    log = spark.createDataFrame([("u", i, i % 4 != 0) for i in range(1, 61)] + [("v", 1, None)], "who string, seq int, there boolean")
    assert [(r["who"], r["seq"], r["undone"], r["left"]) for r in history.undo_last(log, ["who"], ["seq"], "there").orderBy("who").collect()] == [("u", 60, False, 49), ("v", 1, False, 0)]
    asked = spark.createDataFrame([("u", 0), ("u", 1), ("u", 49), ("u", 50), ("u", -1), ("w", 0)], "who string, index int")
    got = {(r["who"], r["index"]): (r["undone"], r["left"]) for r in history.undo_at(log, asked, ["who"], ["seq"], "there").collect()}
    assert got == {("u", 0): (True, 49), ("u", 1): (False, 50), ("u", 49): (False, 50), ("u", 50): (False, 50), ("u", -1): (False, 50), ("w", 0): (False, 0)}
    assert [r["ordinal"] for r in history.in_order(log, ["who"], ["seq"]).where("who = 'u'").orderBy("seq").collect()] == list(range(1, 51))


def test_images_under_a_rule_for_everything_are_named_by_their_caption(spark, tmp_path):
    for n in ("a.jpeg", "b.txt", "c.jpeg"):
        (tmp_path / n).write_text("x")
    calls = []

    def caption(path):
        if path.endswith("c.jpeg"):
            raise ValueError("429" if not calls.append(path) else "")
        return "Dog Park.jpeg"

    files = sources.list_files(spark, str(tmp_path))
    rule = spark.createDataFrame([("any", "", "")], "category string, folder_structure string, naming_convention string")
    answer = lambda p: '{"document_type": "x", "suggested_filename": "Bon: fiscal"}'
    none = spark.createDataFrame([], "original_path string")
    there = spark.createDataFrame([("Organized", "Dog_Parkjpeg.jpeg")], "folder string, name string")
    plan = plans.plan_scan(files, none, rule, extractor=answer, caption=caption, existing=there)
    got = {r["name"]: (r["target"], r["target_folder"]) for r in plan.collect()}
    assert got == {"a.jpeg": ("Dog_Parkjpeg_1.jpeg", "Organized"), "b.txt": ("Bon_ fiscal.txt", "Organized"), "c.jpeg": ("c.jpeg", "Organized")}


def test_a_scan_carried_out(spark, tmp_path):
    (tmp_path / "in/deep/er").mkdir(parents=True)
    for n in ("in/a.txt", "in/deep/b.txt", "in/deep/er/.c.txt", "in/deep/er/_d.txt"):
        (tmp_path / n).write_text(n)
    (tmp_path / "in/link").symlink_to(tmp_path / "in/deep")
    files = sources.list_files(spark, f"{tmp_path}/in")
    assert {r["name"] for r in files.collect()} == {"a.txt", "b.txt", "_d.txt"}
    rule = spark.createDataFrame([("x", "Dosare", "y")], "category string, folder_structure string, naming_convention string")
    decide = lambda p: '{"status": "move", "suggested_name": "n.txt", "suggested_folder": "Dosare"}' if "File: a.txt" in p or "File: b.txt" in p else '{"status": "quarantine", "suggested_name": "q.txt"}'
    store, log = stores.QuarantineStore(spark, f"file://{tmp_path}/store"), history.MoveLog()
    from dosarium.session import materialise

    plan = materialise(plans.plan_scan(files, store.current(), rule, decider=decide), "plan")
    done = plans.carry_out(plan, store, str(tmp_path / "out"), log)
    assert [e for _, _, e in done] == [None, None] and {p.name for p in (tmp_path / "out/Dosare").iterdir()} == {"n.txt", "n_1.txt"}
    assert [(r["id"], r["ai_proposed_name"], r["ai_proposed_folder"]) for r in store.get_all().collect()] == [(1, "q.txt", "Quarantine")]
    # What is under review is not taken up again.
    assert plans.plan_scan(sources.list_files(spark, f"{tmp_path}/in"), store.current(), rule, decider=decide).isEmpty()


def test_keys_and_providers(spark):
    df = spark.createDataFrame([(None,), ("",), (" \xa0",), (" your_api_key_here\n",), ("k",)], "k string")
    assert [(r[0], r[1]) for r in df.select(scan.usable_key(F.col("k")), scan.provider(F.col("k"))).collect()] == [(False, "local")] * 4 + [(True, "cloud")]


def test_paragraphs_pages_and_fences(spark):
    df = spark.createDataFrame([(["a", " ", None, "b"],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in df.select(text.join_paragraphs(F.col("p"))).collect()] == ["a\nb", "", None]
    assert [r[0] for r in df.select(text.first_pages(F.col("p"), 2)).collect()] == ["a", "", None]
    said = ['```json\n{"a": 1}\n```', ' {"a": 1} ', '```\n{"a": 1}\n``` ', "```{}```", "", "x```"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, s string").orderBy("i").select(text.strip_fences(F.col("s"))).collect()]
    for s, g in zip(said, got):
        try:
            assert validate.unfence(s).strip() == g.strip()
        except ValueError:
            assert g == s.strip()
