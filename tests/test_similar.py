"""The registered similarity queries over whole texts on a small table, against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from newsgraph import registry
from newsgraph.operators import similar


def grams(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def alike(x, y):
    g, h = grams(x), grams(y)
    return len(g & h) / len(g | h) if g | h else 0.0


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source, quality, toxic): shared headlines, copies under another headline, near copies, equal texts of several verdicts."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(400)]
    body = lambda: [" ".join(r.choice(words) for _ in range(12)) for _ in range(4)]
    out, texts = [], []
    for i in range(12):
        lines = body()
        other = ["Other headline " + words[i], *lines[1:]]
        near = [*lines[:3], lines[3][: len(lines[3]) // 2]]
        texts += [lines, other, near, ["Shared headline of the day", *body()], lines]
    for i, lines in enumerate(texts):
        label = [(None, None), (1, 0), (0, 1), (1, 1), (0, 0)][r.randrange(5)]
        out.append((i, "\n".join(lines), "en" if i % 25 < 20 else "es", f"src{i % 2}", *label))
    # an equal text of other verdicts has the least id: false 60, verified 61 and 62
    return [*out, (60, texts[0][0] + "\nsame words", "en", "src0", 0, 1), (61, texts[0][0] + "\nsame words", "en", "src0", 1, 0), (62, texts[0][0] + "\nsame words", "en", "src0", 1, 0), (63, "", "en", "src0", 1, 0), (64, None, "en", "src0", 1, 0), (65, None, "en", "src0", None, None)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("similar"))
    spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], r[4], r[5]) for r in rows if r[4] is not None], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def verdict(row):
    return "false" if row[5] == 1 else "verified" if row[4] == 1 else "open"


def classes(rows, *more):
    out = defaultdict(list)
    for r in rows:
        out[(r[1], r[3], r[2], *[m(r) for m in more])].append(r)
    return out


def brute_duplicates(rows):
    items = [(min(r[0] for r in members), key, len(members), max(9 if r[4] == 1 else 4 for r in members)) for key, members in classes(rows).items()]
    out = {(i, i, 1.0, "posible_duplicado") for i, _, n, importance in items if n > 1 and importance >= 6}
    for a, x, _, p in items:
        for b, y, _, q in items:
            if a < b and x[2] == y[2] and max(p, q) >= 6 and (s := alike(x[0], y[0])) > 0.6 and (s > 0.8 or x[1] != y[1]):
                out.add((a, b, round(s, 6), "posible_duplicado" if x[1] == y[1] else "contenido_contradictorio_similar"))
    return out


def test_near_duplicates(spark, rows, folder):
    want = brute_duplicates(rows)
    assert {(r.a, r.b, r.similarity, r.duplicate) for r in registry.QUERIES["near_duplicates"](spark, folder).collect()} == want
    text = {r[0]: r[1] for r in rows}
    assert any(text[a] and text[a].split("\n")[0] != text[b].split("\n")[0] for a, b, *_ in want)  # copies whose first line was changed


@pytest.mark.parametrize("size", [7, 1024])
def test_texts_in_blocks(spark, rows, size):
    """Blocks of any size give the pairs of brute force, within one table and between two."""
    items = [(r[0], r[2], r[1]) for r in rows]
    df = spark.createDataFrame(items, "item long, block string, text string")
    for t in (0.2, 0.6):
        score = {(a, b): alike(x, y) for a, m, x in items for b, n, y in items if m == n and alike(x, y) > t}
        got = [(r.a, r.b, r.similarity) for r in similar.similar_texts(df, None, t, rows=size).collect()]
        assert len(got) == len({g[:2] for g in got}) and {(a, b): pytest.approx(s) for a, b, s in got} == {p: s for p, s in score.items() if p[0] < p[1]}
        both = [(r.a, r.b) for r in similar.similar_texts(df, df, t, rows=size).collect()]
        assert sorted(both) == sorted(score)


def test_overlaps_are_counted_in_parts():
    r = random.Random(1)
    sets = [sorted(r.sample(range(50), r.randint(0, 30))) for _ in range(20)]
    flat, sizes = np.array([g for s in sets for g in s], np.int64), np.array([len(s) for s in sets])
    for columns in (7, 4096):
        assert similar.overlaps(flat, sizes, flat, sizes, columns).tolist() == [[len(set(x) & set(y)) for y in sets] for x in sets]


def test_rare_grams_are_counted_pair_by_pair(monkeypatch):
    """Whatever counts as rare, and however few pairs go at a time."""
    r = random.Random(2)
    sets = [sorted(r.sample(range(60), r.randint(0, 30))) for _ in range(25)]
    side = lambda own: (np.array([g for s in own for g in s], np.int64), np.array([len(s) for s in own]))
    for rare in (0, 0.1, 1):
        monkeypatch.setattr(similar, "RARE", rare)
        for pairs in (1, 50, 1 << 22):
            monkeypatch.setattr(similar, "PAIRS", pairs)
            for own, other in ((sets, sets), (sets[:9], sets[9:])):
                assert similar.overlaps(*side(own), *side(other)).tolist() == [[len(set(x) & set(y)) for y in other] for x in own]


def test_blocks_meet_where_a_pair_can_be(spark, tmp_path):
    """Texts of about one size share a block, those with core apart, and only pairs with core on a side are found."""
    r = random.Random(4)
    items = [(k, "x", sorted(r.sample(range(90), r.randint(20, 80))), k % 3 == 0) for k in range(300)]
    df = spark.createDataFrame(items, "item long, block string, grams array<long>, core boolean").repartition(5)
    blocks = similar._blocks(df, f"file://{tmp_path}/blocks", 0.5, 20).collect()
    assert sum(similar._load(b.file)[0].num_rows for b in blocks) == 300
    for key in {(b.core, b["class"]) for b in blocks}:
        own = sorted((b.split, b.least, b.most) for b in blocks if (b.core, b["class"]) == key)
        assert all(x[2] <= y[1] for x, y in zip(own, own[1:], strict=False))
    assert {b.core for b in blocks} == {True, False} and max(b.most / b.least for b in blocks) < 2
    want = {(a, b) for a, _, x, p in items for b, _, y, q in items if a < b and (p or q) and len({*x} & {*y}) > 0.5 * len({*x} | {*y})}
    got = [(x.a, x.b) for x in similar.similar_texts(df, None, 0.5, rows=20).collect()]
    assert sorted(got) == sorted(want) and want


@pytest.mark.parametrize("name", ["near_duplicates", "conflict_feed"])
def test_pairs_are_rounded_in_plain_arithmetic(spark, folder, name):
    """Spark's round makes a decimal object a row."""
    text = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in text and ("FLOOR(" if name == "near_duplicates" else "rint(") in text


def test_content_membership(spark, rows, folder):
    want = {(r[0], min(m[0] for m in members)) for members in classes(rows).values() for r in members}
    assert {(r.id, r.item) for r in registry.QUERIES["content_membership"](spark, folder).collect()} == want


def test_conflict_feed(spark, rows, folder):
    got = registry.QUERIES["conflict_feed"](spark, folder).collect()
    assert {(r.a, r.b) for r in got if r.feed == "contenido_duplicado"} == {d[:2] for d in brute_duplicates(rows)}
    items = [(min(r[0] for r in members), key) for key, members in classes(rows, verdict).items()]
    want = {(a, b) for a, x in items for b, y in items if x[2] == y[2] and x[3] == "verified" and y[3] == "false" and alike(x[0], y[0]) > 0.4}
    assert {(r.a, r.b) for r in got if r.feed == "conflicto_editorial"} >= want and want
    assert {r.a for r in got if r.feed == "contradiccion_registrada"} == {r[0] for r in rows if r[5] == 1}


def consensus(row):
    return {1: "confirmed", 0: "disputed"}.get(row[4])


def test_whole_conflicts_of_both_kinds(spark, rows, folder):
    groups = classes(rows, verdict, consensus)
    items = [(min(r[0] for r in members), key) for key, members in groups.items()]
    want = set()
    for a, x in items:
        for b, y in items:
            s = alike(x[0], y[0]) if x[2] == y[2] else 0
            if (x[3] == "verified" and y[3] == "false" and s > 0.4) or (x[4] == "confirmed" and y[4] == "disputed" and s > 0.3):
                want.add((a, b))
    got = [(r.a, r.b) for r in registry.QUERIES["conflict_feed"](spark, folder).collect() if r.feed == "conflicto_editorial"]
    assert sorted(got) == sorted(want)
    verdicts = {r[0]: verdict(r) for r in rows}
    assert any(verdicts[a] != "verified" or verdicts[b] != "false" for a, b in got)  # by consensus alone
    members = {(r.id, r.item) for r in registry.QUERIES["verdict_membership"](spark, folder).collect()}
    assert members == {(r[0], min(m[0] for m in group)) for group in groups.values() for r in group}
    assert (62, 61) in members and (61, 60) in got and {i for pair in got for i in pair} <= {item for _, item in members}


def test_texts_are_not_shuffled(spark, tmp_path):
    """Conflicts shuffle digests and trigrams: less than half of the texts' bytes, where whole texts went through two shuffles."""
    from pathlib import Path

    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(300)]
    docs = [(i, " ".join(r.choice(words) for _ in range(2500)), "en", f"src{i % 2}") for i in range(60)]
    spark.createDataFrame([*docs, (60, docs[0][1], "en", "src0")], "doc_id long, text string, lang string, source string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f: f.stat().st_size for d in folders for f in Path(d).glob("*/shuffle_*.data")}
    before = files()
    assert registry.QUERIES["conflict_feed"](spark, str(tmp_path)).count()
    shuffled = sum(n for f, n in files().items() if f not in before)
    assert 0 < shuffled < sum(len(d[1]) for d in docs) / 2


def test_repeated_rows_are_members_of_one_class(spark, tmp_path):
    """A row that is there twice, and an id with two texts, give no pair twice."""
    rows = [(1, "one two three four", "en", "s"), (1, "one two three four", "en", "s"), (1, "quite another text", "en", "s"), (2, "one two three four five", "en", "t"), (3, "quite another text here", "en", "t"), (4, None, "en", "s"), (5, "...", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.a, r.b, r.duplicate) for r in registry.QUERIES["near_duplicates"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, "posible_duplicado"), (1, 2, "contenido_contradictorio_similar"), (1, 3, "contenido_contradictorio_similar")]


def test_stored_index_answers_as_a_join_does(spark, tmp_path):
    """Appends, ties, repeated names, names without trigrams, and a stored side that isn't moved."""
    import random

    from newsgraph.operators import similar as op
    from newsgraph.operators.gram_index import GramIndex

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 6)))
    rows = [(k, f"{word()} {word()}", "xy"[k % 2]) for k in range(200)] + [(500, "same name", "x"), (501, "same name", "x"), (502, None, "x"), (503, "...", "y")]
    stored = spark.createDataFrame(rows, "id long, name string, kind string")
    asked = spark.createDataFrame([(n[:-1] if n else n, k) for _, n, k in rows[::3]] + [("same nam", "x"), ("", "x"), (None, "y"), ("zzz", "x"), ("same name", "z")], "name string, kind string")
    index = GramIndex(spark, "grams_test", f"file://{tmp_path}/index", 4)
    for part in range(3):
        index.append(stored.where(f"id % 3 = {part}"))
    for t, strictly in ((0.3, False), (0.5, True), (0.8, False)):
        key = lambda x: (x.name or "", x.kind, x.name is None)
        got = {key(x): (x.entity, round(x.score, 9), x.is_new) for x in index.resolve(asked, t, strictly).collect()}
        want = {key(x): (x.entity, round(x.score, 9), x.is_new) for x in op.resolve(asked.where("name is not null"), stored, t, strictly).collect()}
        assert {k: v for k, v in got.items() if not k[2]} == want and got["", "y", True] == (None, 0.0, True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for an index that is too large for that
    try:
        plan = index.candidates(asked.distinct(), 0.5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    at = next(k for k, line in enumerate(lines) if "Bucketed: true" in line)
    join = max(k for k in range(at) if "Join" in lines[k])
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, here = [], depth(lines[at])
    for line in reversed(lines[join + 1 : at]):  # from the scan up to the join
        if depth(line) < here:
            above.append(line)
            here = depth(line)
    assert "Bucketed: true" in plan and not any("Exchange" in line for line in above)
    index.drop()
