"""Vector codes, filter audit and exact top-k against brute force, with the rows tables should not have but do."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import exact_topk, filter_audit, vector_codes
from tablewright.llm.common import ship
from tablewright.llm.vectors import whole

# Columns of other names, and of names the operators use inside.
VECTORS = "vec_id long, embedding array<double>, label int, state string, code string, error string, rank int, score double, x int, salt int, own int"
DOCS = "doc_id long, text string, source string, mask int, n int, digest string, part string, words int, good string, step int, list string, first string"
LABELS = "doc_id long, quality int, toxic int, good int, n int"


def vectors(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, v, label, "s", "c", "e", 1, 0.5, 2, 3, 4) for i, v, label in rows], VECTORS)


def odd_rows(seed=0, n=700, width=12, centres=40):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, width))
    rows = [(int(i), (middle[draw.integers(centres)] + 0.2 * draw.normal(size=width)).tolist(), int(draw.integers(4)) if i % 3 else 1) for i in draw.permutation(n)]
    same = rows[5][1]
    rows += [(n + i, list(same), None) for i in range(60)]  # a group of equal vectors
    rows += [(n + 100, [1.0, 2.0], 7), (n + 101, [], 7), (n + 102, [0.0] * width, 7), (None, list(same), 2), (rows[3][0], [0.25] * width, 2),
             rows[4], (n + 103, None, 1), (n + 104, [1.0, None], 1), (n + 105, [1.0, math.nan], 1), (n + 106, [math.inf] * width, 1)]
    return rows


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def padded(v, width):
    return [math.floor(1024 * x) for x in v] + [0] * (width - len(v))


def brute_codes(rows, rounds=4, entries=256):
    rows = sorted(usable(rows), key=lambda r: (r[0] is None, r[0], r[1]))
    width = -(-max((len(r[1]) for r in rows), default=0) // 4)
    x = np.array([padded(r[1], 4 * width) for r in rows], dtype=np.int64).reshape(len(rows), 4, width)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return far.argmin(axis=2), far.min(axis=2).sum(axis=1)

    for _ in range(rounds):
        code, _ = assign()
        for p, e in itertools.product(range(4), range(books.shape[1])):
            own = x[code[:, p] == e, p]
            if len(own):
                books[p, e] = own.sum(axis=0) // len(own)
    code, error = assign()
    by_label = {}
    for r, e in zip(rows, error.tolist()):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    return sorted(((r[0] is None, r[0] or 0, "".join(f"{c:02x}" for c in own), e, by_label[r[2]], digest)
                   for r, own, e in zip(rows, code.tolist(), error.tolist())))


@pytest.mark.parametrize("entries", [256, 37])
def test_codes_equal_exhaustive_rounds(spark, entries):
    rows = odd_rows()
    found = vector_codes.vector_codes(vectors(spark, rows).repartition(3), entries=entries).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == brute_codes(rows, entries=entries)
    # Bounds rule out most comparisons of the later rounds.
    assert sum(r.compared for r in found) < 0.6 * len(found) * 4 * entries * 5


def test_codes_of_few_or_no_rows(spark):
    few = [(3, [1.5, -2.0, 0.5], 1), (1, [1.5, -2.0, 0.5], None), (2, [0.0] * 5, None)]
    found = vector_codes.vector_codes(vectors(spark, few)).collect()
    assert sorted((False, r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == brute_codes(few)
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1), (2, [math.nan], 1)])).count() == 0
    assert vector_codes.vector_codes(vectors(spark, [])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256", "compared"]


def test_distances_are_exact_for_large_numbers():
    x, entries = np.array([[2**29, -2**29 + 1]]), np.array([[2**29 - 1, -2**29], [0, 0]])
    assert vector_codes.squared(x, entries).tolist() == [[2, 2**58 + (2**29 - 1) ** 2]]
    small = np.random.default_rng(1).integers(-900, 900, (50, 6))
    assert (vector_codes.squared(small, small[:20]) == ((small[:, None] - small[None, :20]) ** 2).sum(axis=2)).all()
    with pytest.raises(OverflowError):
        vector_codes.squared(np.array([[2**40]]), np.array([[0]]))


def test_net_displacement_is_at_most_the_sum_of_drifts_and_bounds_hold():
    draw = np.random.default_rng(3)
    x = draw.integers(-1000, 1000, (400, 4, 5))
    history = [x[:64].transpose(1, 0, 2).copy()]
    state = vector_codes.start(x, history[0], 4)
    for _ in range(6):
        history.append(history[-1] + draw.integers(-60, 61, history[-1].shape))
        moved = vector_codes.net_displacement(history)
        drifts = sum(np.sqrt(((b - a).astype(float) ** 2).sum(axis=2)) for a, b in zip(history, history[1:]))
        assert (moved[0] <= drifts * 1.0001).all() and (len(history) == 2 or (moved[0] < drifts * 0.9).any())
        vector_codes.advance(state, x, history, moved)
        far = ((x[:, :, None, :] - history[-1][None]) ** 2).sum(axis=3)
        assert (state["code"] == far.argmin(axis=2)).all()
    # Bounds kept from earlier rounds are still in use.
    assert len(np.unique(state["lower_at"])) > 1


def brute_top(rows, every, k):
    rows = [r for r in usable(rows) if r[0] is not None]
    width = max((len(r[1]) for r in rows), default=0)
    asks = {}
    for i, v, _ in rows:
        if i % every == 0:
            asks[i] = max(asks.get(i, v), v)
    out = []
    for q, v in asks.items():
        own = np.array(padded(v, width), dtype=object)
        ranked = sorted((-int((own * padded(c, width)).sum()), i) for i, c, _ in rows if i != q)
        out += [(q, place, i, -s) for place, (s, i) in enumerate(ranked[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("every", "k", "components"), [(100, 10, 1 << 21), (7, 3, 60), (100, 5000, 1)])
def test_top_k_equals_brute_force(spark, every, k, components):
    rows = odd_rows(seed=2)
    found = exact_topk.top_k(vectors(spark, rows).repartition(3), every, k, components).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_top(rows, every, k)


def test_top_k_blocks_and_sparse_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=9) * (draw.random(9) < 0.3)).tolist(), 0) for i in range(300)]
    scan = exact_topk._scan(type("Held", (), {"value": (np.array([0, 100]), whole(_array([rows[0][1], rows[100][1]]), 9))}), 4)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), _array([r[1] for r in rows])], names=["vec_id", "embedding"])
    found = [tuple(r.values()) for out in scan([batch]) for r in out.to_pylist()]
    assert sorted(found) == sorted((q, i, s) for q, _, i, s in brute_top(rows, 100, 4) if q < 200)


def _array(values):
    import pyarrow as pa
    return pa.array(values, pa.list_(pa.float64()))


def test_top_k_without_rows_and_beyond_a_long(spark):
    assert exact_topk.top_k(vectors(spark, [])).count() == 0
    assert exact_topk.top_k(vectors(spark, [(100, [1.0], 1)])).count() == 0
    with pytest.raises(Exception, match="does not fit into a long"):
        exact_topk.top_k(vectors(spark, [(100, [1e9], 1), (1, [1e9], 1)])).collect()


def texts():
    draw = np.random.default_rng(8)
    plain = [" ".join(f"w{draw.integers(int(spread))}" for _ in range(int(n))) for n, spread in zip(draw.integers(150, 260, 60), draw.integers(40, 400, 60))]
    rows = [(i, t + (" $5" if i % 3 == 0 else "") + (" LOUD WORDS ARE HERE" if i % 4 == 0 else ""), f"s{i % 3}") for i, t in enumerate(plain)]
    same = rows[7][1]
    rows += [(i, same, "s1" if i % 2 else "hot") for i in range(200, 260)]  # a group of copies over two parts
    rows += [(300, None, "s1"), (301, "", None), (302, "", ""), (None, same, "s1"), (None, None, None), (200, same, "hot"), (210, "other text", "hot"),
             (400, "a\x1cb c É \U0001f600 &", "s2"), (401, " \t\n\x0b\f\r ", "s2"), (402, "word " * 200_000, "s2"), (403, "A" * 3 + "é" * 150, "s2"), (404, "A" * 3 + "é" * 147, "s2")]
    return rows


def brute_audit(rows, labels):
    import re
    docs = [(i, t or "", s or "") for i, t, s in rows]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    facts = []
    for i, t, s in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        facts.append((s, {f for f, x in fails.items() if x}, i in good if i is not None else False, i in toxic if i is not None else False))
    out = {}
    for part in {f[0] for f in facts}:
        own, total = [f for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[1]]
                before = set(order[:step - 1])
                alive = [x for x in alive if f not in x[1]]
                out[part, "".join(order), step] = [len(alive), len(gone), sum(f in x[1] and bool(x[1] & before) for x in own),
                                                   sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                total[f] += len(gone)
        for (name, order, step), values in out.items():
            if name == part:
                values.append(total[order[step - 1]])
    return out


def test_audit_equals_applying_the_filters(spark):
    ship(spark)
    rows = texts()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(7, 1, 0), (7, 0, 0), (200, 0, 1), (None, 1, 1), (205, None, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, 1, 2, "d", "p", 3, "g", 4, "l", "f") for i, t, s in rows], DOCS).repartition(4)
    marks = spark.createDataFrame([(i, q, x, 1, 1) for i, q, x in labels], LABELS)
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
             for r in filter_audit.filter_audit(docs, marks).collect()}
    assert found == brute_audit(rows, labels)
    # More parts than one block of them.
    many = docs.withColumn("source", F.col("doc_id").cast("string"))
    assert filter_audit.filter_audit(many, marks).count() == 600 * (many.select("source").distinct().count())


def test_audit_of_no_rows(spark):
    ship(spark)
    assert filter_audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
