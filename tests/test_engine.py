import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import api, cli
from palimpsest.functions import raster
from palimpsest.functions.columns import array_distance, csv_field, hamming
from palimpsest.operators import groups, join
from palimpsest.sources import files, png, sinks
from palimpsest.spec import DCT, DHASH, spec_named
from palimpsest.streaming import matching


def test_hamming(spark):
    cases = [(10, 10, 0), (0, 15, 4), (15, 0, 4), (0, -1, 64), (0, 30, 4), (15, 30, 2)]
    df = spark.createDataFrame(cases, "a long, b long, d int")
    assert all(r[0] == r[1] for r in df.select(hamming(F.col("a"), F.col("b")), "d").collect())
    assert df.select(array_distance(F.array("a", "b"), F.array("b", "a"))).first()[0] == 0


def test_specs():
    assert spec_named("other") == DCT
    assert DCT.with_threshold(5) == DCT and DCT.with_threshold(5).threshold == 5 and DCT.with_threshold(0).threshold == 22
    assert DHASH != DCT


def brute(rows, t):
    out = set()
    for i, x in enumerate(rows):
        for y in rows[:i]:
            d = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(x[1:], y[1:], strict=True))
            if d < t and x[0] != y[0]:
                out.add((min(x[0], y[0]), max(x[0], y[0]), d))
    return out


@pytest.mark.parametrize("strategy", ["broadcast", "band", "block"])
def test_strategies_are_exact(spark, strategy):
    r = random.Random(3)
    base = [(r.getrandbits(63), r.getrandbits(63)) for _ in range(20)]
    rows = []
    for i in range(150):
        a, b = r.choice(base)
        for _ in range(r.randrange(8)):
            a, b = a ^ (1 << r.randrange(63)), b ^ (1 << r.randrange(63))
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "id long, w0 long, w1 long")
    assert {tuple(x) for x in join.within(df, 10, strategy).collect()} == brute(rows, 10)


def test_within_is_strict_and_survives_odd_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 7), (3, 15), (4, None)], "id long, w0 long")
    for strategy in ("broadcast", "band", "block"):
        assert {tuple(x) for x in join.within(df, 3, strategy).collect()} == {(2, 3, 1)}
        assert join.within(df.limit(0), 3, strategy).count() == 0


@pytest.mark.parametrize("strategy", ["band", "block"])
@pytest.mark.parametrize("words", [1, 2])
def test_cells_are_exact(spark, monkeypatch, strategy, words):
    """Many cells, values of bands that are cut into blocks, copies and repeated ids."""
    monkeypatch.setattr(join, "BLOCK_ROWS", 40)
    monkeypatch.setattr(join, "VALUE_ROWS", 0)
    r = random.Random(6)
    base = [[r.getrandbits(64) - 2**63 for _ in range(words)] for _ in range(12)]
    rows = [(i % 280, *(w ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) ^ (r.randrange(2) << 9) for w in r.choice(base))) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:20], "id long, " + ", ".join(f"w{k} long" for k in range(words)))
    got = join.within(df, 14, strategy)
    assert sorted(tuple(x) for x in got.collect()) == sorted(brute(rows, 14))
    x, y = df.where("id < 90"), df.where("id >= 90")
    assert {tuple(x) for x in join.between(x, y, 14, strategy).collect()} == {p for p in brute(rows, 14) if p[0] < 90 <= p[1]}


@pytest.mark.parametrize("strategy", ["band", "block"])
def test_no_row_is_made_of_a_pair_that_does_not_match(spark, strategy):
    """3,000 random prints within 19 bits: 4.5 million pairs, of which few match."""
    words = np.random.default_rng(1).integers(-(2**63), 2**63, 3000)
    found = join.within(spark.createDataFrame(enumerate(words.tolist()), "id long, w0 long"), 19, strategy)
    assert found.count() < 10_000
    assert "MergeJoin" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def plain_groups(pairs):
    near, ids, skip, out = {}, set(), set(), []
    for a, b, d in pairs:
        near.setdefault(a, []).append((-d, b))
        near.setdefault(b, []).append((-d, a))
        ids |= {a, b}
    for i in sorted(ids):
        if i not in skip:
            g = [i, *(x for _, x in sorted(near[i]))]
            skip |= set(g)
            out.append(g)
    return out


def test_groups(spark, monkeypatch):
    r = random.Random(5)
    for n, m in ((3, 2), (40, 50), (60, 150)):
        pairs = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b})
        pairs = [(a, b, (a * 7 + b) % 5) for a, b in pairs]
        df = spark.createDataFrame(pairs, "a long, b long, dist int")
        for few in (groups.FEW, 0):
            monkeypatch.setattr(groups, "FEW", few)
            got = [x["members"] for x in groups.groups(groups.members(df)).orderBy("group_id").collect()]
            assert got == plain_groups(pairs)
    assert groups.groups(groups.members(df.limit(0))).count() == 0


def test_groups_by_rounds(spark, monkeypatch):
    """Components that count as large shrink by rounds before what is left is walked."""
    monkeypatch.setattr(groups, "FEW", 0)
    monkeypatch.setattr(groups, "LARGE", 20)
    r = random.Random(8)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(160)) if a != b})
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, dist int")
    want = {g[0] for g in plain_groups([(a, b, 1) for a, b in pairs])}
    assert {x["seed"] for x in groups.seeds_of(df).collect()} == want


@pytest.mark.parametrize("few", [groups.FEW, 0])
def test_a_long_chain_settles(spark, monkeypatch, few):
    """Items in order that each match the next only, as frames of a film do."""
    monkeypatch.setattr(groups, "FEW", few)
    df = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1).alias("dist"))
    got = groups.members(df)
    assert sorted(x["seed"] for x in got.where("ord = 0").collect()) == list(range(0, 5001, 2))
    assert got.groupBy("seed").count().where("count > 3").count() == 0


def test_groups_of_copies(spark):
    """Equal fingerprints are compared once and no pairs of them are made; groups are those of all items."""
    r = random.Random(2)
    base = [r.getrandbits(63) for _ in range(6)] + [3, 7, 1]
    rows = [(i, r.choice(base)) for i in range(300)] + [(500, 3), (501, 1 << 62)]
    df = spark.createDataFrame(rows, "id long, w0 long")
    got = [x["members"] for x in groups.groups(groups.members_of(df, 3)).orderBy("group_id").collect()]
    assert got == plain_groups(sorted(brute(rows, 3)))


def test_groups_without_links(spark, monkeypatch):
    """Kinds are compared with seeds, some kinds at a time; no table of links is made, which has a share of all pairs."""
    made, kept = [], groups.kept
    monkeypatch.setattr(groups, "HEAD", 25)
    monkeypatch.setattr(groups, "kept", lambda df, name: made.append(name) or kept(df, name))
    r = random.Random(9)
    rows = [(i, r.choice([1, 3, 1 << 40, (1 << 50) - 1, -1, -8]) ^ (r.randrange(16) << r.randrange(56))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, w0 long")
    got = [x["members"] for x in groups.groups(groups.members_of(df, 5, "block")).orderBy("group_id").collect()]
    assert got == plain_groups(sorted(brute(rows, 5)))
    assert "near-seeds" in made and not {"links", "kind-links"} & set(made)


def test_groups_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 0), (1, 255), (2, 1), (3, 254), (4, None), (6, 85 << 40)], "id long, w0 long")
    assert [x["members"] for x in groups.groups(groups.members_of(df, 3)).collect()] == [[1, 2, 3]]
    assert groups.members_of(df.limit(0), 3).count() == groups.members_of(df.where("id > 4"), 3).count() == 0


def test_many_blank_images(spark):
    df = spark.range(200_000).select("id", F.lit(0).cast("long").alias("w0"))
    assert groups.members_of(df, 22).agg(F.count("*"), F.max("ord"), F.countDistinct("group_id")).first()[:] == (200_000, 199_999, 1)


@pytest.mark.parametrize("strategy", ["broadcast", "band", "block"])
def test_between_tables(spark, strategy):
    r = random.Random(4)
    base = [r.getrandbits(63) for _ in range(8)]
    rows = [(i, r.choice(base) ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63))) for i in range(120)]
    new, old = rows[:30], rows[30:]
    got = {tuple(x) for x in join.between(*(spark.createDataFrame(t, "id long, w0 long") for t in (new, old)), 5, strategy).collect()}
    ids = {i for i, _ in new}
    assert got == {(a, b, d) for a, b, d in brute(rows, 5) if (a in ids) != (b in ids)}


def test_streaming_matches_batches_with_all_before(spark, tmp_path):
    r = random.Random(7)
    base = [r.getrandbits(63) for _ in range(5)]
    rows = [(i, r.choice(base) ^ (1 << r.randrange(63))) for i in range(60)]
    (tmp_path / "in").mkdir()
    stored, found = str(tmp_path / "stored"), str(tmp_path / "links")
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], "id long, w0 long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, w0 long").parquet(str(tmp_path / "in"))
        matching.match_stream(stream, stored, found, 4, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(x) for x in matching.links(spark, found).collect()} == brute(rows, 4)
    matching.match_batch(spark.createDataFrame(rows[40:], "id long, w0 long"), stored, found, 4, 2)  # a batch that runs again
    assert matching.links(spark, found).count() == len(brute(rows, 4))


def test_csv_field(spark):
    df = spark.createDataFrame([("a,b",), ('say "x"',), ("plain",), (" lead",), ("two\nlines",)], "p string")
    assert [r[0] for r in df.select(csv_field(df.p)).collect()] == ['"a,b"', '"say ""x"""', "plain", '" lead"', '"two\nlines"']


@pytest.fixture
def pictures(tmp_path):
    r = np.random.default_rng(4)
    made = []
    for k in range(3):
        a = np.full((40, 40, 4), 255, np.uint8)
        a[..., :3] = np.kron(r.integers(0, 256, (8, 8, 3)), np.ones((5, 5, 1)))
        for name, b in ((f"{k}a.png", a), (f"{k}b.png", raster.resize(a, 60, 60, raster.FILTERS["linear"]))):
            (tmp_path / name).write_bytes(png.encode(b))
            made.append(str(tmp_path / name))
    (tmp_path / "broken.png").write_bytes(b"no")
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.png").write_bytes((tmp_path / "0a.png").read_bytes())
    return tmp_path


def test_folders_named_like_images(tmp_path):
    """Names decide: a folder of such a name is listed too, and looked into only with the option."""
    (tmp_path / "b.png").mkdir()
    (tmp_path / "b.png" / "c.png").write_bytes(b"x")
    (tmp_path / "a.png").write_bytes(b"x")
    name = lambda paths: [p[len(str(tmp_path)) :] for p in paths]
    assert name(files.find_images(str(tmp_path))) == ["/a.png", "/b.png"]
    assert name(files.find_images(str(tmp_path), True)) == ["/a.png", "/b.png", "/b.png/c.png"]
    assert name(files.find_images(str(tmp_path / "b.png"))) == ["/b.png", "/b.png/c.png"]
    assert files.find_images(str(tmp_path / "none")) == []


def test_lists_and_sinks(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.png  b.png\nc.png\n\n")
    assert [r["path"] for r in files.list_from_text(spark, str(tmp_path / "list.txt")).collect()] == ["a.png", "b.png", "c.png"]
    rows = spark.createDataFrame([(1, ["x", "y, z"]), (0, ['say "a"'])], "group_id long, paths array<string>")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect()] == ['"say ""a"""', 'x,"y, z"']
    assert [sinks.summary(n, t) for n, t in ((0, None), (3, None), (2, "t.png"))] == ["No duplicate images found", "These 3 images are duplicates", "These 2 images are duplicates of t.png"]
    assert files.expand([str(tmp_path / "list.txt"), str(tmp_path), "missing"]) == []


def test_command_line_actions(spark, pictures, capsys, monkeypatch):
    import io

    import palimpsest

    def said(*args, stdin=""):
        out = io.StringIO()
        code = cli.run([*args], spark, stdin=io.StringIO(stdin), out=out)
        return code, out.getvalue().splitlines()

    (pictures / "broken.png").unlink()
    a, folder = str(pictures / "0a.png"), str(pictures)
    code, lines = said("-r", a, folder)
    assert code == 0 and lines[0] == f"These 3 images are duplicates of {a}" and len(lines) == 2
    assert said("-r", "-search", a, folder)[1][0] == "These 8 images are duplicates"
    assert said("-q", folder) == (0, []) and said("-", stdin=f"{a} {pictures}/0b.png\n")[1][0] == "These 1 images are duplicates of " + a
    assert said("-hash", "dhash", str(pictures / "0a.png"), str(pictures / "1a.png"))[1] == ["No duplicate images found"]
    assert said(a)[0] == 1
    assert said("-o", "-c", str(pictures / "linked"), folder)[0] == 0 and len(list((pictures / "linked").iterdir())) == 3
    assert said("-o", "-d", folder)[0] == 0 and len(list(pictures.glob("*.png"))) == 3
    monkeypatch.setattr(palimpsest, "__version__", "")
    monkeypatch.setattr(palimpsest, "COMMIT", "abc")
    assert said("-version") == (0, ["dev-abc"])


def test_listing(pictures):
    assert len(files.find_images(str(pictures))) == 7 and len(files.find_images(str(pictures), True)) == 8
    assert files.is_image_name("a.png") and not files.is_image_name("a.PNG") and not files.is_image_name("a.gif") and files.is_image_name("x.tar.jpg")
    assert files.image_or_dir("")[1:] == (False, False)


@pytest.mark.parametrize("spec", [DCT, DHASH], ids=lambda s: s.name)
def test_duplicates_and_compare(spark, pictures, spec):
    paths = files.find_images(str(pictures), True)
    members, errors = api.duplicates(spark, spec, paths)
    by = {}
    for r in members.collect():
        by.setdefault(r["group_id"], []).append(r["path"].rsplit("/", 1)[1])
    assert sorted(sorted(v) for v in by.values()) == [["0a.png", "0b.png", "c.png"], ["1a.png", "1b.png"], ["2a.png", "2b.png"]]
    assert "broken.png" in errors.first()["error"] and errors.count() == 1
    found, _ = api.compare(spark, spec, paths[0], paths)
    assert {r["path"].rsplit("/", 1)[1] for r in found.collect()} == {"0a.png", "0b.png", "c.png"}


def test_command_line(spark, pictures, capsys):
    import io

    out = io.StringIO()
    assert cli.run(["-o", "-m", str(pictures / "moved"), str(pictures)], spark, out=out) == 1  # one file is broken
    assert len(out.getvalue().splitlines()) == 3
    assert sorted(p.name for p in (pictures / "moved").iterdir()) == ["group0", "group1", "group2"]
    assert cli.run([], spark) == 1 and cli.run(["-version"], spark, out=out) == 0


def test_file_actions(tmp_path):
    a = tmp_path / "a.png"
    a.write_text("1")
    assert not sinks.link_files([str(a)], str(tmp_path / "l")) and len(sinks.link_files([str(a)], str(tmp_path / "l"))) == 1
    assert not sinks.move_files([str(a)], str(tmp_path / "m")) and not a.exists()
    assert len(sinks.delete_files([str(a), str(tmp_path / "m" / "a.png")])) == 1
