"""The ten operators on small tables: brute force, round trips, and the cases that tables should not have but do."""

import itertools
import random

import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

from tablewright.llm import decontamination, jaccard_join, language, licences, line_dedup, linkage, neighbours, packing, surrogates, token_counts, toxicity
from tablewright.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, id string, part string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wise owls watch from tall old trees near water".split()


def text(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    long = text(1, 6000)
    rows = [(1, text(2, 80)), (2, text(2, 80)), (3, text(2, 79) + " changed"), (4, ""), (5, None), (None, text(2, 80)), (6, "   \n\t "), (7, long),
            (8, "one two"), (9, "one two"), (9, "one two"), (10, "...!"), (11, text(3, 200)), (12, "line a of many\nline a of many\n\nline b, quite another")]
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return spark.createDataFrame([], DOCS)


def test_packing_is_gapless_whole_and_tight(docs, nothing):
    rows = packing.pack(docs, capacity=64, shard_pieces=1000).collect()
    tokenizer = packing.encoder(packing.public_tokenizers.path(packing.TOKENIZER)).tokenizer
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == list(itertools.accumulate([0] + [n for _, n in sorted(parts)]))[:-1]
        assert sum(n for _, n in parts) <= 64
    for d in docs.where("doc_id in (1, 4, 5, 7)").collect():
        ids = np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d.doc_id)
        assert own == [(k, a, len(ids[a:a + 64]), zlib.crc32(ids[a:a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert len([r for r in rows if r.doc_id == 9]) == 2 and packing.pack(nothing).count() == 0


def test_encoder_equals_the_tokenizer():
    own = packing.encoder(packing.public_tokenizers.path(packing.TOKENIZER))
    for x in ("It's 12³ ²½ don't", "a\x1cb c\xa0d", "<|endoftext|> x", "İstanbul ΣΑΣ", "été a ́b", "日本語 👍🏽", "Ärger, über__x", ""):
        assert own.encode(x) == np.array(own.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes(), x


def test_fit_uses_few_bins():
    lengths = np.random.default_rng(0).integers(1, 101, 3000)
    bins, offsets = packing.fit(lengths, 100)
    assert bins.max() + 1 <= 1.03 * np.ceil(lengths.sum() / 100)
    for b in range(bins.max() + 1):
        own = sorted(zip(offsets[bins == b], lengths[bins == b]))
        assert own[-1][0] + own[-1][1] <= 100 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:]))


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    lead = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while any(lead[a] != lead[b] for a, b in links):
        for a, b in links:
            lead[a] = lead[b] = min(lead[a], lead[b])
    return {i: (len(s), lead[i]) for i, s in sets.items()}


def test_jaccard_join_equals_brute_force(spark, docs, nothing):
    draw = random.Random(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(160):
        words = text(k % 12, 60).split()
        for _ in range(draw.randrange(4)):
            words[draw.randrange(len(words))] = f"edit{draw.randrange(9)}"
        rows.append((100 + k, " ".join(words)))
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute_components(rows, 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == expected
    assert len(found) == len(rows) and [r.component_id for r in found if r.doc_id is None] == [None]
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_jaccard_group_beyond_a_block(spark):
    """More near copies than a block holds, few of them linked to the hub."""
    draw, rows = random.Random(3), []
    base = text(77, 40).split()
    for k in range(400):
        words = list(base)
        for _ in range(draw.choice([0, 1, 1, 2])):
            words[draw.randrange(40)] = f"e{draw.randrange(30)}"
        rows.append((k, " ".join(words)))
    ship(spark)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_components(rows, 4, 85)


def test_blocks_of_a_large_group_meet_in_rounds(spark, monkeypatch):
    """Where ids are in many pairs of blocks, their facts are moved in rounds, with the same components."""
    staged, stage = [], linkage.stage
    monkeypatch.setattr(linkage, "ROUND_ROWS", 100)
    monkeypatch.setattr(linkage, "BLOCK", 128)
    monkeypatch.setattr(linkage, "stage", lambda df, label: staged.append(label) or stage(df, label))
    draw, rows = random.Random(3), []
    base = text(77, 40).split()
    for k in range(400):
        words = list(base)
        for _ in range(draw.choice([0, 1, 1, 2])):
            words[draw.randrange(40)] = f"e{draw.randrange(30)}"
        rows.append((k, " ".join(words)))
    ship(spark)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_components(rows, 4, 85)
    assert staged.count("jaccard-met") > 3  # one of counts, one for each of two passes at least


def test_trie_search_equals_sets():
    draw = np.random.default_rng(1)
    for _ in range(40):
        base = np.unique(draw.integers(0, 200, 40))
        sets = [np.unique(np.concatenate([base[draw.random(len(base)) < 0.93], draw.integers(0, 200, 3)])) for _ in range(25)]
        trie = jaccard_join.Trie(list(enumerate(sets)))
        for probe in sets:
            assert set(trie.search(probe, 85)) == {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(probe, s)) >= 85 * len(np.union1d(probe, s))}


def test_shingles_are_hashed_for_many_texts_at_once(monkeypatch):
    """Word runs of any bytes, cut into chunks anywhere, are the sets that words as text make."""
    texts = ["", " \t\n", "A b", "a B", "\u00dcn\u00ef x\x0by\x0cz", "\x85a\xa0b c\x1cd", "w" * 300 + " x y", "w" * 236 + "x" + "w" * 63 + " x y", "one", "a " * 50, text(4, 300), text(4, 299)]
    words = [tuple(x.encode().lower().split()) for x in texts]
    whole = [{w[k:k + 3] for k in range(max(1, len(w) - 2))} if w else set() for w in words]
    for limit in (1, 40, 40_000):
        monkeypatch.setattr(jaccard_join, "SHINGLE_CHARS", limit)
        found = jaccard_join.Shingler(3).all(texts)
        assert all((np.diff(x) > 0).all() and (len(x) == 0 or x[0] >= 0) for x in found)
        for (a, s), (b, t) in itertools.product(zip(found, whole), repeat=2):
            assert len(a) == len(s) and len(np.intersect1d(a, b)) == len(s & t)


def test_pool_hashes_are_counted_in_ranges(spark, docs, monkeypatch):
    draw = np.random.default_rng(11)
    pools = [(i, 9, np.unique(draw.integers(-(1 << 62), 1 << 62, 40)[:6]).tolist() + [5, -7 - i % 20]) for i in range(60)]
    table = spark.createDataFrame(pools, "id long, n long, pool array<long>").repartition(3)
    for parts in (1, 9):
        counts = jaccard_join.pool_counts(table, parts)
        assert {(r.bucket, r.frequent) for r in counts.collect()} == {(5, True), *((-7 - k, False) for k in range(20))}
    for limit in (0, 1000):  # without and with the hashes carried to the tasks
        monkeypatch.setattr(linkage, "CARRIED_KEYS", limit)
        rows = {(r.id, r.n, r["at"], r.bucket, r.frequent) for r in jaccard_join.shared_hashes(table, counts).collect()}
        assert rows == {(i, 9, len(p) - 2 + k, p[len(p) - 2 + k], k == 0) for i, _, p in pools for k in (0, 1)}


def test_line_dedup(spark, docs, nothing):
    line = text(9, 12)
    more = spark.createDataFrame([(50, line + "\nown words here only", "l", "s", 0, "", "", ""), (51, line.replace("quick", "quack", 1) + "!\nother, longer words there", "l", "s", 0, "", "", "")], DOCS)
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs.unionByName(more)).collect()}
    assert found[50].text == line + "\nown words here only" and found[51].text == "other, longer words there"
    assert found[12].text == "line a of many\n\nline b, quite another" and found[12].n_chars == len(found[12].text)
    assert 2 not in found and 3 not in found and found[4].text == "" and found[5].text is None and found[6].text == "   \n\t "
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_equals_brute_force(spark):
    """Short lines with small edits, and a group of more lines than a block holds."""
    draw, base = random.Random(8), "the watchful owls near the old water tower wait for seven foxes"
    lines = ["Copyright 2020 Example Corporation. All rights reserved worldwide.", "Copyright 2021 Example Corporation. All rights reserved worldwide."]
    for k in range(380):
        line = list(base if k < 300 else text(k // 4, 8))
        for _ in range(draw.choice([0, 1, 1, 2])):
            line[draw.randrange(len(line))] = draw.choice("abcdefgh")
        lines.append("".join(line).strip())
    sets = [{x[i:i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    lead = list(range(len(lines)))
    links = [(a, b) for a, b in itertools.combinations(lead, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(lead[a] != lead[b] for a, b in links):
        for a, b in links:
            lead[a] = lead[b] = min(lead[a], lead[b])
    ship(spark)
    table = spark.createDataFrame([(i, x, "en", "s", len(x), "", "", "") for i, x in enumerate(lines)], DOCS)
    found = {r.doc_id for r in line_dedup.dedup_lines(table).collect()}
    assert found == {i for i, k in enumerate(lead) if i == k} and 1 not in found


def test_lines_that_are_not_alike_do_not_meet(spark, docs, monkeypatch):
    """Lines with a passage in common share few buckets, and texts are cut a second time once."""
    staged, stage = {}, line_dedup.stage

    def counted(df, label, *how):
        out = stage(df, label, *how)
        staged.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stage", counted)
    passage = text(40, 8)
    lines = [passage + " " + text(100 + k, 24) for k in range(300)] + [text(100, 20), text(100, 20) + " x"]
    table = spark.createDataFrame([(i, x, "en", "s", len(x), "", "", "") for i, x in enumerate(lines)], DOCS)
    assert sorted(r.doc_id for r in line_dedup.dedup_lines(table).collect()) == list(range(301))
    assert staged["lines-involved"][0] < 100 and len(staged["lines-texts"]) == 1


def test_shared_sets_equal_a_dictionary():
    draw = np.random.default_rng(3)
    keys, ids = draw.integers(0, 400, 2000, dtype=np.uint64) * np.uint64(1 << 40), draw.integers(-30, 30, 2000)
    have = {}
    for k, i in zip(keys.tolist(), ids.tolist()):
        have.setdefault(k, set()).add(i)
    found = {}
    for b, i in zip(*(x.tolist() for x in line_dedup.shared_sets(keys, ids))):
        found.setdefault(b, []).append(i)
    assert sorted(tuple(sorted(x)) for x in found.values()) == sorted({tuple(sorted(x)) for x in have.values() if len(x) > 1})
    assert [len(x) for x in line_dedup.shared_sets(keys[:0], ids[:0])] == [0, 0]


def test_band_keys_find_similar_lines_in_any_part(spark, docs):
    """Lines that share a band share a bucket, whatever number of tasks the keys are dealt to."""
    line = text(60, 20)
    rows = [(1, line), (2, line + " x"), (3, text(61, 20)), (4, text(62, 20) + " " + line)]
    known = line_dedup.sign_lines(spark.createDataFrame(rows, "doc_id long, text string"), 5).where("n is not null")
    ids = {x: np.uint64(line_dedup.line_id(x)).astype(np.int64) for _, x in rows}
    for parts in (1, 7):
        found = {}
        for r in line_dedup.band_buckets(known, range(line_dedup.BANDS), parts).collect():
            found.setdefault(r.bucket, set()).add(r.id)
        assert {ids[line], ids[line + " x"]} in found.values() and not any(ids[rows[2][1]] in x for x in found.values())


def test_decontamination(spark, docs, nothing):
    passage = text(2, 80).split()
    items = spark.createDataFrame([(1, " ".join(passage[10:30]).upper() + "!"), (2, text(99, 30)), (3, "one two"), (4, None), (None, text(2, 80)), (5, "")], "item_id long, text string")
    pairs = {(r.doc_id, r.item_id): r.containment for r in decontamination.contaminated(docs, items).collect()}
    assert set(pairs) == {(1, 1), (2, 1), (3, 1)} and pairs[1, 1] == 1.0
    left = decontamination.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 3
    assert decontamination.contaminated(nothing, items).count() == 0 and decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_neighbours_equal_brute_force_on_few(spark):
    ship(spark)
    draw = np.random.default_rng(2)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(300, 8)).astype(np.float32))]
    data += [(400 + i, data[7][1]) for i in range(60)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0]), (904, None), (905, [None] + [1.0] * 7)]
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = [(i, np.array(v)) for i, v in data if i < 900]
    assert set(found) == {i for i, _ in usable if i % 20 == 0}
    for q, rows in found.items():
        vector = dict(usable)[q]
        best = sorted(((-float(v @ vector), i) for i, v in usable if i != q))[:20]
        assert [i for _, i, _ in sorted(rows)] == [i for _, i in best]
        assert np.allclose([s for _, _, s in sorted(rows)], [-s for s, _ in best])
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_mixtures(spark, docs, nothing):
    samples = {"en": "the house and the garden with water of this river ", "de": "das haus und der garten mit wasser von diesem fluss ", "fr": "la maison et le jardin avec de l'eau de cette rivière "}
    rows = [(i, " ".join(random.Random(i).sample(samples[k].split(), 9)), k) for i, k in enumerate(itertools.islice(itertools.cycle(samples), 300))]
    ship(spark)
    model = language.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, samples["de"]), (2, samples["en"] * 3 + samples["fr"] * 3), (3, None), (4, "12 34 !"), (5, ""), (6, samples["fr"] * 5000)], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identify(asked, model).collect()}
    assert found[1].lang_pred == "de" and set(found[2].proportions) == {"en", "fr"} and found[6].lang_pred == "fr"
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (3, 4, 5))
    assert {r.lang_pred for r in language.identify(docs, language.learned(nothing)).collect()} == {"und"}
    assert language.identify(nothing, model).count() == 0


def test_foreign_and_junk_rows_go_one_by_one(spark):
    samples = {"en": "the house and the garden with water of this river ", "de": "das haus und der garten mit wasser von diesem fluss ", "fr": "la maison et le jardin avec de l'eau de cette rivière "}
    rows = [(i, " ".join(random.Random(i).sample(samples[k].split(), 9)), k) for i, k in enumerate(itertools.islice(itertools.cycle(samples), 300))]
    ship(spark)
    model = language.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    draw = random.Random(1)
    junk = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60))
    asked = [(1, samples["en"]), (1, None), (1, ""), (2, samples["en"] + samples["de"] + samples["fr"]), (3, "今天天气很好我们一起去公园散步"), (4, "Сегодня хорошая погода и мы пошли гулять"), (5, junk), (None, junk),
             (None, samples["de"]), (6, "12 34 !")]
    kept = language.in_known_languages(spark.createDataFrame(asked, "doc_id long, text string"), model, 0.4).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, samples["en"]), (2, asked[3][1]), (0, samples["de"])])


def test_segments_are_the_maximal_ones():
    draw = np.random.default_rng(4)
    for _ in range(200):
        scores = draw.normal(size=draw.integers(1, 25))
        found = toxicity.segments(scores)
        assert found == sorted(found) and all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:]))
        sums = [(scores[a:b].sum()) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        assert np.isclose(max((s for _, _, s in found), default=0.0), max(0.0, max(sums)))


def test_toxicity(spark, docs, nothing):
    ship(spark)
    rows = [(i, text(i, 60) + (" you utter numskull nitwit " + text(i + 1, 20) if i % 4 == 0 else "")) for i in range(600)]
    table = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (901, None)], "doc_id long, toxic int")
    found = toxicity.score_documents(table, labels).collect()
    assert len(found) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert toxicity.score_documents(docs, labels.limit(0)).count() == docs.count() and toxicity.score_documents(nothing, labels).count() == 0


def test_surrogates(spark, docs, nothing):
    rows = [(1, "a.b@x.example.com, 10.0.0.1 +1 (386) 555-3733"), (2, "Mrs. Ada Miller met Mr. Miller; mail a.b@x.example.com"), (3, None), (3, ""), (4, "4111 1111 1111 1111 password=b7db7aa4a5fcc78305")]
    found = {(r.doc_id, r.replaced): r.text for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    mail = found[1, 3].split(",")[0]
    assert found[2, 3].endswith(mail) and mail.endswith(".com") and "a.b@" not in mail
    names = found[2, 3].split(";")[0].replace(".", "").split()
    assert names[0] == "Mrs" and names[1] in surrogates.FEMALE and names[2] == names[5]
    digits = [int(c) for c in found[4, 2][:19] if c.isdigit()]
    assert sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) + sum(digits[-1::-2]) == sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) and found[4, 2][4] == " "
    many = spark.createDataFrame([("family", f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)], "kind string, value string")
    assigned = surrogates.assign(many).collect()
    assert len(assigned) == 300 == len({r.surrogate for r in assigned}) and not {r.surrogate for r in assigned} & {r.value for r in assigned}
    assert surrogates.replace_entities(docs).count() == docs.count() and surrogates.replace_entities(nothing).count() == 0


def test_surrogates_leave_nothing_of_a_mention(spark):
    rows = ["+1 (826) 555-4081 190.137.223.204", "+1 (843) 555-7672 4111 1111 1111 1111", "+49 30 1234567 123-45-6789", "call +33 6 12 34 56 78 now",
            'TOKEN = "B7DB7AA4A5FCC78305B7DB7AA4A5FCC783050A1B"!!', 'password = "hunter2x"', """{'Api_Key': 'k3y-w!th.dots'}""", "DB_PASSWORD=S3cret.x9", "B7DB7AA4A5FCC78305B7DB7AA4A5FCC783050A1B",
            "met Anna Maria Schmidt there", "met Mr. Juan Carlos de la Vega O'Neill there", "Anna-Lena K. McDonald", "token: a.b@x.example.com", "mail a.b@x.example.com"]
    asked = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r for r in surrogates.replace_entities(asked).collect()}
    gone = ["4081 190 137 223 204", "843) 7672 4111 1111", "1234567 123-45-6789", "12 34 56 78", "B7DB7AA4", "hunter2x", "k3y w!th dots", "S3cret x9", "B7DB7AA4",
            "Anna Maria Schmidt", "Juan Carlos Vega O'Neill", "Lena McDonald", "a.b@", "a.b@"]
    for i, words in enumerate(gone):
        assert not [w for w in words.split() if w in found[i].text.split("(843")[0]] and found[i].replaced == (2 if i < 3 else 1), (i, found[i].text)
    assert found[4].text[:9] == 'TOKEN = "' and found[4].text[9:49] == found[8].text == found[8].text.upper() and found[4].text[49:] == '"!!'
    assert found[9].text.startswith("met ") and found[9].text.endswith(" there") and " de la " in found[10].text and found[12].text[7:] == found[13].text[5:]
    few = spark.createDataFrame([("secret", f"{chr(97 + i)}!!!!!") for i in range(26)], "kind string, value string")
    assert len({r.surrogate for r in surrogates.assign(few).collect()}) == 26


def test_licences(spark, nothing):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.txt", "nothing here"), ("a/b/d/LICENSE", "Licensed under the Apache License, Version 2.0."),
            ("a/b/d/e.txt", None), ("a/b/d/f.txt", "some words\nLicensed under CC BY-NC 4.0.\nmore words of the file itself"), ("g.txt", "no license to speak of in this plain text"), (None, "x"), ("g.txt", "")]
    found = {r.path: (r.licence, r.kind, r.inherited_from) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found["a/b/c.txt"] == ("MIT", "inherited", "a/LICENSE") and found["a/b/d/e.txt"] == ("Apache-2.0", "inherited", "a/b/d/LICENSE")
    assert found["a/b/d/f.txt"] == ("CC-BY-NC-4.0", "notice", None) and found["g.txt"] == (None, None, None) and len(found) == 6
    assert licences.scan(nothing.select(F.col("id").alias("path"), "text")).count() == 0


def test_licences_inline_wrapped_and_whole(spark):
    mit, filler = licences.TEMPLATES["MIT"][-1], "words of the file itself and nothing else "
    wrapped = "\n".join(" * " + " ".join(licences.TEMPLATES["Apache-2.0"][2].split()[k:k + 9]) for k in range(0, 90, 9))
    asked = {"a": ("Copyright 2020 Jane Roe. Released under the MIT License. " + filler, "MIT"), "b": (filler * 9 + "\n/*\n" + wrapped + "\n */\n" + filler * 9, "Apache-2.0"),
             "c/LICENSE": ("MIT License\n\nCopyright (c) 2020 Jane Roe\n\n" + mit.replace(", ", ",\n"), "MIT"), "d": ("Apache License", "Apache"), "e": ("GNU GENERAL PUBLIC LICENSE", "GPL"),
             "f": ("# SPDX-License-Identifier: EPL-2.0\ncode", "EPL-2.0"), "g": ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
             "h": (filler + "licensed under the\n# GNU Lesser General Public License, version 2.1. " + filler, "LGPL-2.1"), "i": ("Licensed under the Apache License, Version 1.1.", "Apache"),
             "j": (licences.TEMPLATES["BSD-3-Clause"][-1], "BSD-3-Clause"), "k": (filler + "we ask for permission and a license", None), "c/x.py": (filler, "MIT")}
    asked = {k if "/" in k else f"{k}/x": x for k, x in asked.items()}
    rows = [(k, x) for k, (x, _) in asked.items()]
    found = {r.path: r.licence for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {k: x for k, (_, x) in asked.items()}


def test_edited_trees_equal_full_counts():
    own, draw, letters = token_counts.counter(token_counts.public_tokenizers.path(token_counts.TOKENIZER)), random.Random(3), " \n'srelv a1B.é  "
    for k in range(600):
        now = "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 5, 40, 300])))
        tree = token_counts.Tree(*own.leaves(now))
        for _ in range(draw.randint(1, 5)):
            now = tree.edit(now, draw.randint(-2, len(now) + 3), draw.choice([0, 0, 1, 3, 50]), "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 4]))), own)
            assert tree.tokens == sum(own.leaves(now)[1]) and [n for chars, _ in tree.leaves for n in chars] == own.leaves(now)[0]


def test_edits_from_a_table(spark, docs, nothing):
    edits = spark.createDataFrame([(1, 0, 3, 2, "zz"), (1, 1, 0, 0, "Start "), (5, 0, 0, 0, "new"), (4, 0, 9, 9, None)], "doc_id long, turn int, at int, drop int, put string")
    found = {r.doc_id: r for r in token_counts.apply_edits(token_counts.count_tokens(token_counts.with_edits(docs.select("doc_id", "text"), edits))).collect()}
    before = docs.where("doc_id = 1").first().text
    own = token_counts.counter(token_counts.public_tokenizers.path(token_counts.TOKENIZER))
    assert found[1].text == "Start " + before[:3] + "zz" + before[5:] and found[1].tokens_after == sum(own.leaves(found[1].text)[1]) and found[1].encoded < 20
    assert found[5].text == "new" and found[4].text == "" and found[6].tokens_before == found[6].tokens_after
    assert token_counts.apply_edits(token_counts.count_tokens(nothing)).count() == 0


def test_pipeline_stages_take_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(text(3, 200).split()[50:80]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    assert {1, 7, 8, 12} <= kept and not kept & {2, 4, 5, 6, 9, 10, 11}
    assert [r.doc_id for r in rows if r.doc_id == 7] and {r.length for r in rows if r.doc_id == 8} == {3}


def test_hashed_sets_rule_out_nothing_similar():
    draw = random.Random(4)
    lines = ["".join(draw.choice("abcdef ") for _ in range(draw.randrange(1, 90))) for _ in range(300)]
    edited = ["".join(c if draw.random() > 0.03 else draw.choice("xyz") for c in x) for x in lines]
    for right in (edited, lines[::-1]):
        likely = line_dedup.may_be_similar(lines, right, 5, 80)
        for a, b, kept in zip(lines, right, likely):
            x, y = line_dedup.shingle_set(a, 5), line_dedup.shingle_set(b, 5)
            similar = 100 * len(x & y) >= 80 * len(x | y)
            assert kept or not similar
    values, at = line_dedup.hashed_sets(lines, 5)
    assert np.diff(at).tolist() == [len(line_dedup.shingle_set(x, 5)) for x in lines]


def test_similar_lines_agree_in_sketches_without_texts(spark, docs):
    """What is kept of every line rules out no similar pair and holds no text."""
    draw = random.Random(6)
    lines = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(40, 120))) for _ in range(1500)]
    edited = ["".join(c if draw.random() > 0.02 else draw.choice("xyz") for c in x) for x in lines]
    (_, left, sizes), (_, right, _) = line_dedup.signatures(lines), line_dedup.signatures(edited)
    agree = (left == right).sum(axis=1)
    sets = [(line_dedup.shingle_set(a, 5), line_dedup.shingle_set(b, 5)) for a, b in zip(lines, edited)]
    similar = [100 * len(x & y) >= 80 * len(x | y) for x, y in sets]
    assert sum(similar) > 200 and agree[np.array(similar)].min() >= line_dedup.AGREE_HUB
    assert sizes.tolist() == [len(x) for x, _ in sets]
    assert line_dedup.sign_lines(docs, 5).columns == ["doc_id", "text_id", "line", "id", "bands", "sketch", "n"]


CLASH = "doc_id long, text string, lang string, source string, n_chars long, lost string, lost_id string, line int, dropped_id int, dirty_id int, own int, edits string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "l", "i", 1, 2, 3, 4, "e") for i, t in rows], CLASH)


def test_rows_that_share_an_id_keep_their_own_lines(spark, docs):
    shared = "some shared boilerplate line that many documents have in common"
    rows = [(1, shared), (2, shared + "\nown line of the first text with this number, quite long"),
            (2, "totally unique sentence that must never be lost\nsecond line of it, which is also its own"), (3, "alone"), (4, ""), (5, None)]
    df = clashing(spark, rows)
    kept = line_dedup.dedup_lines(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id < 5").collect()) == sorted(
        [rows[0], (2, rows[1][1].split("\n")[1]), rows[2], rows[3], rows[4]])
    assert kept.where("doc_id = 5").count() == 1


def test_repeated_rows_are_one_document(spark, docs):
    rows = [(7, text(21, 60))] * 3 + [(8, text(22, 60)), (9, text(22, 60))] + [(10, None)] * 2
    left = jaccard_join.one_of_each(line_dedup.dedup_lines(clashing(spark, rows)))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([rows[0], rows[3], (10, None)], key=lambda x: x[0])


def test_columns_of_clashing_names_pass_through(spark, docs):
    df = clashing(spark, [(1, text(31, 90)), (2, text(32, 90)), (3, text(31, 90) + " " + text(33, 40)), (None, "x")])
    items = spark.createDataFrame([(1, text(33, 40))], "item_id long, text string")
    clean = decontamination.decontaminate(df, items)
    assert clean.columns == df.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 1, 2]
    assert jaccard_join.one_of_each(df).count() == 4 and line_dedup.dedup_lines(df).columns == df.columns
    assert token_counts.count_tokens(df).count() == 4
    edits = spark.createDataFrame([(1, 1, 0, 1, "Z")], "doc_id long, turn int, at int, drop int, put string")
    assert token_counts.apply_edits(token_counts.count_tokens(token_counts.with_edits(df, edits))).where("encoded > 0").count() == 1
