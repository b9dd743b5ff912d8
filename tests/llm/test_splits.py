import random
from itertools import product

from darkroom.llm.splits import assign_splits, closest_subset, photo_groups, reached_shares

SCHEMA = "id long, photo string, person string, label string, v int"
SHARES = "split_name string, share double"


def g(i, kind):
    return f"{kind:08x}-0000-0000-0000-{i:012x}"


def rows_of(rng, n, persons, photos):
    out = []
    for i in range(n):
        p, q = g(rng.randrange(persons), 1), g(rng.randrange(photos), 2)
        out.append((i, rng.choice([q, q.upper(), "{" + q + "}"]), rng.choice([p, p.replace("-", ""), " " + p, None]), "x", 1))
    return out


def norm(s):
    h = s and s.strip(" {}").replace("-", "").lower()
    return h and f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def brute(rows):
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for _, q, p, *_ in rows:
        if p and q:
            up[find(norm(q))] = find(norm(p))
    by = {}
    for x in up:
        by.setdefault(find(x), set()).add(x)
    return by.values()


def test_groups(spark, staging):
    rng = random.Random(1)
    rows = rows_of(rng, 400, 150, 300) + [(10_000 + i, g(5_000 + i, 2), g(0, 1), "x", 1) for i in range(200)]
    rows += [(20_000 + i, g(8_000 + i, 2), g(9_000 + i + d, 1), "x", 1) for i in range(60) for d in (0, 1)]  # a chain
    rows += rows[:30] + [(30_000, None, g(1, 1), "x", 1), (30_001, g(1, 2), None, "x", 1)]
    got = {tuple(r) for r in photo_groups(spark.createDataFrame(rows, SCHEMA), "person", "photo", 2, staging).select("label", "photo").collect()}
    want = set()
    for s in brute(rows):
        people = [x for x in s if x.startswith("00000001")]
        photos = [x for x in s if x.startswith("00000002")]
        if len(photos) >= 2:
            want |= {(min(people), x) for x in photos}
    assert got == want


def test_splits_keep_groups_and_shares(spark, staging):
    rng = random.Random(2)
    rows = rows_of(rng, 900, 700, 900) + [(5_000, None, None, "x", 1)]
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], SHARES)
    out = {r["id"]: r["split_name"] for r in assign_splits(spark.createDataFrame(rows + rows[:9], SCHEMA), shares, "id", "person", "photo", staging).collect()}
    assert set(out) == {r[0] for r in rows}
    for s in brute(rows):
        assert len({out[r[0]] for r in rows if norm(r[1]) in s or (r[2] and norm(r[2]) in s)}) == 1
    n = len(rows)
    for name, share in (("validation", 0.1), ("test", 0.1)):
        assert abs(sum(v == name for v in out.values()) - share * n) <= 2


def test_a_record_without_a_photo_stays_with_its_person(spark, staging):
    rows = [(i, g(i, 1), g(i % 5, 0), "x", 1) for i in range(50)] + [(100 + i, None, g(i % 5, 0), "x", 1) for i in range(10)] + [(200, None, g(77, 0), "x", 1), (201, "bad", g(77, 0), "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    shares = spark.createDataFrame([("train", 0.6), ("test", 0.4)], "split_name string, share double")
    out = {r["id"]: r["split_name"] for r in assign_splits(df, shares, "id", "person", "photo", staging).collect()}
    assert len(out) == 62 and out[200] == out[201]
    for i in range(10):
        assert out[100 + i] == out[i % 5]
    reached = {r["split_name"]: (r["records"], r["wanted"]) for r in reached_shares(spark.createDataFrame([(k, v) for k, v in out.items()], "id long, split_name string"), shares).collect()}
    assert reached["train"][0] + reached["test"][0] == 62 and abs(reached["train"][0] - 37) <= 8


def test_subset_of_many_sizes():
    rng = random.Random(9)
    sizes = {rng.randrange(1, 2000): rng.randrange(1, 6) for _ in range(300)}
    total = sum(s * n for s, n in sizes.items())
    took = closest_subset(sizes, total // 3)
    assert all(0 < n <= sizes[s] for s, n in took.items()) and sum(s * n for s, n in took.items()) == total // 3


def test_subset_against_all_choices():
    rng = random.Random(3)
    for _ in range(200):
        sizes = {rng.randrange(1, 12): rng.randrange(1, 4) for _ in range(4)}
        target = rng.randrange(0, 40)
        chosen = closest_subset(sizes, target)
        assert all(0 <= n <= sizes[s] for s, n in chosen.items())
        total = sum(s * n for s, n in chosen.items())
        best = min(abs(target - sum(s * n for s, n in zip(sizes, c))) for c in product(*[range(m + 1) for m in sizes.values()]))
        assert abs(total - target) == best


def test_empty(spark, staging):
    empty = spark.createDataFrame([], SCHEMA)
    assert photo_groups(empty, "person", "photo", 2, staging).count() == 0
    shares = spark.createDataFrame([("train", 0.8), ("test", 0.2)], SHARES)
    assert assign_splits(empty, shares, "id", "person", "photo", staging).count() == 0
