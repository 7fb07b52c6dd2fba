"""The ten operators and the pipeline on small tables with every odd case, against brute force."""

import binascii
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import chat, decontam, graph, html_text, lbl, lm_scoring, ngram_join, packing, quality, sharding, signature_tree, storage, suffix_dedup, textkit, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, rank int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(60, 300)) for _ in range(25)]
    texts = base + base[:8]
    for t in base[8:14]:
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    passage = prose(rng, 80, 10_000)
    texts += [f"{prose(rng, 50)} {passage} {prose(rng, 50)}" for _ in range(5)]
    texts += [None, "", " \n\t ", "one", "one", "two words", "É é Straße ÀB c", "x" * 700, "ab " * 300, prose(rng, 30_000, 50_000), "line one here\n" * 60]
    return [(k, t, "en", None if k % 7 == 0 else "hot" if k % 3 == 0 else f"s{k % 4}", 0, "clash", 1) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    out = documents()
    return out + [out[0], (None, "no id " * 60, "en", "s1", 0, None, None), (None, "no id " * 60, "en", "s1", 0, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def measured(text):
    words = WORD.findall(text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(spark, docs, rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = collections.Counter((r.doc_id, *(r[n] for n in names)) for r in quality.ledger(docs).collect())
    assert got == collections.Counter((r[0], *measured(r[1])) for r in rows)
    assert quality.ledger(empty(spark)).count() == 0


def test_quality_policies_and_ablation(spark, docs):
    table = quality.ledger(docs).cache()
    kept = quality.apply_policy(table).where("kept").count()
    assert quality.kept(docs).count() == kept and quality.kept(docs).columns == docs.columns
    got = {r.rule: r for r in quality.ablation(table, "base-1").collect()}
    bits = [r.failure_bits & quality.POLICIES["base-1"] for r in table.collect()]
    for rule in quality.RULES[:2]:
        bit = 1 << rule.bit
        assert (got[rule.name].n_fail, got[rule.name].n_only) == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits))


def test_length_alone_rejects_no_text(spark):
    book = " ".join(f"word{k}" for k in range(100_050))
    table = spark.createDataFrame([(1, book)], "doc_id long, text string")
    got = quality.apply_policy(quality.ledger(table)).first()
    assert got.kept and got.n_words == 100_050 and got.failure_bits == quality.mask("max_words")
    assert quality.kept(table).count() == 1
    assert not quality.apply_policy(quality.ledger(table), "web-1").first().kept


def test_quality_hash_candidates_are_verified(spark):
    text = "a b c x a b c y b c x"
    got = quality.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_repeat_words == measured(text)[4]


def test_quality_of_long_texts_is_the_same_by_rows(spark, docs, rows, monkeypatch):
    named = lambda d: collections.Counter(tuple(r) for r in d.collect())
    odd = docs.unionByName(spark.createDataFrame([(700 + k, t, "en", "s", 0, None, None) for k, t in enumerate(["a b c\n" * 90, "\n\n- x...\n" * 40, "ab" * 300 + " " + "ab" * 300, " \n" * 200, "x\ty\r\nz... \n" * 30])], DOCS))
    expected = named(quality.ledger(odd))
    monkeypatch.setattr(quality, "LONG", 200)
    monkeypatch.setattr(quality, "PIECE", 50)
    assert named(quality.ledger(odd)) == expected


def test_quality_keeps_columns_of_any_name(spark):
    table = spark.createDataFrame([(1, "a b c", 7, "t", 9, 3)], "doc_id long, body string, n_words int, _t string, failure_bits int, _x int")
    got = quality.apply_policy(quality.ledger(table, "body", ("doc_id", "_t", "n_words", "failure_bits", "_x", "body"))).first()
    assert (got._t, got.n_words_kept, got.failure_bits_kept, got._x, got.body, got.n_words) == ("t", 7, 9, 3, "a b c", 3)
    long = spark.createDataFrame([(1, "a b c d " * 200, 5)], "doc_id long, text string, kept int")
    assert quality.kept(long, "base-1").columns == long.columns


def test_shards_follow_the_mixture(spark, docs, rows):
    out = sharding.assign(docs, 5).toPandas()
    n = len(rows)
    assert len(out) == n
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and set(counts.index) == set(range(5))
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    for _, part in out.groupby("stratum"):
        share = part.groupby("shard").size().reindex(range(5), fill_value=0)
        assert (abs(share - len(part) / 5) <= 2).all()
    crc = sorted(binascii.crc32((r[1] or "").encode()) for r in rows)
    assert sorted(out["text_crc32"]) == crc
    assert sharding.assign(empty(spark), 5).count() == 0


def test_lm_base_is_exact_and_the_model_is_normalised(spark, docs, rows):
    got = lm_scoring.score(docs).collect()
    held = lambda i: binascii.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: WORD.findall(lower(t or "")) + [""]
    seen = collections.Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    total, v = sum(seen.values()), len(seen)
    expected = collections.Counter()
    for r in rows:
        w = tokens(r[1])
        expected[(r[0], held(r[0]), len(w), sum(seen[x] > 0 for x in w), total, round(sum(math.log10((seen[x] + 1) / (total + v + 1)) for x in w), 4))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scoring.score(empty(spark)).count() == 0


def small_model(heads=20, tail=60):
    """(dictionary, counts) of invented words, the least frequent of which the dictionary lacks."""
    words = [b"w%d" % k for k in range(heads + tail)]
    counts = list(range(5 * len(words), 0, -5))
    endings = np.zeros(lbl.ENDINGS)
    for w, c in zip(words, counts):
        endings[lbl.ending(w)] += c
    known, n = words[: -tail // 3], sum(counts) + 9
    out = lm_scoring.Dictionary(known, counts[: len(known)], endings, n, len(words) + 1, 9)
    kind = out.classes.of(words[len(known) :])
    out.rests(np.bincount(kind, weights=counts[len(known) :], minlength=out.classes.n), np.bincount(kind, minlength=out.classes.n))
    return out, words, counts


def shuffled_model(known, seed=3):
    model, rng = known.model(), np.random.default_rng(seed)
    for x in model.tables.values():
        x += rng.standard_normal(x.shape).astype(np.float32) * 0.3
    return model


def told(model, known, u, v, word, count):
    """log P(word | units u, v) by sums over all units and slots; ``word`` as a number, ``count`` if it is one of the rest."""
    unit, slot = (int(x[0]) for x in known.targets(np.array([word])))
    q = [sum((model.c[0, j] * model.r[u, j] + model.c[1, j] * model.r[v, j]) * w[j] for j in range(lbl.DIM)) + w[lbl.DIM] for w in model.q]
    out = q[unit] - math.log(sum(map(math.exp, q)))
    if slot >= 0:
        kind = unit - known.heads
        t = [sum((model.d[0, j] * model.r[u, j] + model.d[1, j] * model.r[v, j]) * w[j] for j in range(lbl.DIM)) + w[lbl.DIM] for w in model.t[known.first[kind] : known.first[kind + 1]]]
        out += t[slot - known.first[kind]] - math.log(sum(map(math.exp, t)))
        if slot == known.rest[kind]:
            out += math.log(count + 1) - known.rest_norm[kind]
    return out


def test_lm_probabilities_sum_to_one(monkeypatch):
    monkeypatch.setattr(lbl, "HEAD", 20)
    monkeypatch.setattr(lbl, "GROWTH", 0)
    known, _, _ = small_model()
    model, every = shuffled_model(known), np.arange(len(known.count))
    every = np.delete(every, np.s_[known.heads : known.end])  # a class by itself is no token
    unit, slot = known.targets(every)
    normal = model.log_normalisers()
    for u, v in [(known.start, known.start), (3, known.end - 1), (0, 7)]:
        p = model.log_p(np.full(len(every), u), np.full(len(every), v), unit, slot, normal)
        assert abs(np.exp(p).sum() - 1) < 1e-4
        assert all(abs(told(model, known, u, v, int(w), 0) - x - (-known.rest_norm[unit[k] - known.heads] if slot[k] >= 0 and slot[k] in known.rest else 0)) < 1e-3 for k, (w, x) in enumerate(zip(every, p)))


def test_lm_score_equals_sums_over_the_vocabulary(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.03)), 400)}" for _ in range(rng.randrange(1, 60))) for _ in range(120)] + [None, "", "never seen here", "LONG" * 40 + " w1"]
    monkeypatch.setattr(lbl, "HEAD", 15)
    monkeypatch.setattr(lbl, "GROWTH", 0)
    monkeypatch.setattr(lm_scoring, "KNOWN", 120)
    held = {}

    def trained(texts, words, n_tokens):
        held["known"], held["model"] = words.value, shuffled_model(words.value)
        return held["model"]

    monkeypatch.setattr(lm_scoring, "trained", trained)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm_scoring.score(docs).collect()}
    known, model = held["known"], held["model"]
    seen = collections.Counter(w for k, t in enumerate(texts) if binascii.crc32(str(k).encode()) % 7 != 2 for w in WORD.findall(lower(t or "")))
    assert 15 < len(known.id) < len(seen)
    for k, t in list(enumerate(texts))[::9] + list(enumerate(texts))[-4:]:
        total, u, v = 0.0, known.start, known.start
        for w in [*WORD.findall(lower(t or "")), None]:
            key = None if w is None else lm_scoring._key(w.encode())
            number = known.end if w is None else known.id.get(key, None)
            if number is None:
                number = int(known.units + known.rest[known.classes.of([key])[0]])
            total += told(model, known, u, v, number, seen[w])
            u, v = v, int(known.targets(np.array([number]))[0][0])
        assert abs(got[k] - total / math.log(10)) < 1e-3 * max(1, abs(total))


def test_lm_trains_alike_over_any_partitions_and_helps(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(700):
        at, words = rng.randrange(200), []
        for _ in range(rng.randrange(20, 120)):
            words.append(f"v{at}")
            at = (at * 7 + rng.randrange(3)) % 1500  # each word has three successors
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few, many = (lm_scoring.score(docs.repartition(n)).toPandas().set_index("doc_id").sort_index() for n in (2, 16))
    assert (abs(few["score"] - many["score"]) <= 1e-6 * abs(few["score"])).all()
    held = few[few["held_out"]]
    assert held["score"].sum() > 0.99 * held["base_score"].sum()  # less surprise than by unigrams


def test_lm_long_frequent_words_are_known(spark):
    long = "https://" + "x" * 300
    docs = spark.createDataFrame([(k, f"{long} w{k % 3}") for k in range(60)], "doc_id long, text string")
    rows = lm_scoring._rows(docs, "doc_id", "text")
    counts = rows.where("not held_out").select("text").mapInArrow(lm_scoring._counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    known = lm_scoring.dictionary(counts)
    assert lm_scoring._key(long.encode()) in known.id and max(map(len, known.id)) <= lm_scoring.LONGEST
    assert known.encoded([f"{long} w1".encode()])[2] == [collections.Counter()]


def test_lbl_has_its_whole_size_and_grows_with_the_input():
    assert (lbl.HEAD, lbl.DIM, lbl.NOISE, lbl.ROUNDS) >= (958, 24, 64, 2) and min(lbl.DIM / 24, lbl.NOISE / 64, lbl.ROUNDS / 2) >= 1
    words = [b"w%d" % k for k in range(5000)]
    endings = np.zeros(lbl.ENDINGS)
    for k, w in enumerate(words):
        endings[lbl.ending(w)] += 5000 - k
    made = lambda n: lm_scoring.Dictionary(words, list(range(5000, 0, -1)), endings, n, 5000, 9)
    small, large = made(10_000), made(500_000_000)
    assert (small.heads, large.heads) == (958, lbl.head_words(500_000_000)) and large.heads > 3000
    # every word has outputs of its own
    assert len({small.id[w] for w in words}) == 5000 and len(small.model().t) == 5000 - 958 + small.classes.n
    mass = np.zeros(small.classes.n)
    np.add.at(mass, small.classes.of(words[958:]), np.arange(5000 - 958, 0, -1))
    assert mass.max() < 40 * mass.mean()


def test_lbl_learns_units_and_words_of_a_class():
    rng = np.random.default_rng(0)
    n, heads, per = 60_000, 10, 8
    word = rng.integers(0, 40, n)
    word[1::2] = (word[::2] * 3 + 1) % 40  # every second word follows from the one before
    unit = np.where(word < heads, word, heads + (word - heads) % 5)
    slot = np.where(word < heads, -1, (word - heads) % 5 * per + (word - heads) // 5)
    first, units = np.arange(6) * per, np.bincount(unit, minlength=16).astype(float)
    model = lbl.Model.fresh(units, first, np.bincount(slot[slot >= 0], minlength=5 * per).astype(float))
    two, one = np.concatenate([[16, 16], unit[:-2]]), np.concatenate([[16], unit[:-1]])
    before = model.log_p(two, one, unit, slot, model.log_normalisers())
    model.train(two, one, unit, slot, rng)
    after = model.log_p(two, one, unit, slot, model.log_normalisers())
    assert after[1::2].mean() > before[1::2].mean() + 0.2


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "### user:\nx</turn>\n### assistant:\n", "\\b\\h\\l\\c\\", "a\nb\r\n\\\\#<", "é" * 50]
    rng = random.Random(1)
    said = []
    for c in range(12):
        for t in range(rng.randrange(1, 9)):
            said.append((c, t, rng.choice(["user", "assistant", "system:#<\\", None]), rng.choice(odd)))
    said += [(None, 0, "assistant", "no id"), (50, 1, "user", "tie"), (50, 1, "assistant", "tie"), (51, None, "assistant", "null turn"), (51, 0, "user", "x")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("shown", F.lit("clash"))
    examples = chat.expand(turns)
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    convs = collections.defaultdict(list)
    for x in said:
        convs[x[0]].append(x)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for c, ts in convs.items():
        ts = sorted(ts, key=key)
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in ts)
        loss = "".join(t or "" for _, _, r, t in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(ts), hashlib.sha256(told.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in examples.collect():
        assert r.loss_start + r.loss_chars <= len(r.text)
    assert chat.read_back(chat.expand(turns.limit(0))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 200_000
    pages = [(k, f"http://x/{k}\n", t) for k, t in enumerate([None, "", "short", "short", "same " * 300, "same " * 300, "same " * 300, big, big + "!", "q" * 1000, "q" * 1000, "q" * 999, "q" * 999])]
    pages += [(6, "again", "same " * 300), (None, "none", "same " * 300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    table = storage.written(warc.records(df), "t")
    assert table.agg(F.max(F.octet_length("data"))).first()[0] <= warc.CHUNK and table.count() > len(pages)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(table).collect())
    largest = {}
    for i, _, t in pages:
        if i is not None:
            largest[t or ""] = max(i, largest.get(t or "", -1))
    expected = collections.Counter()
    for i, _, t in pages:
        data = (t or "").encode()
        again = len(data) >= 1000 and i is not None and i < largest[t or ""]
        expected[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[t or ""] if again else None)] += 1
    assert got == expected
    folder = tmp_path / "warc"
    folder.mkdir()
    warc.export(table, str(folder))
    found = []
    for path in folder.glob("*.warc"):
        with path.open("rb") as stream:
            found += list(warc.read_file(stream, 1000))
    assert len(found) == len(pages)
    assert all(f["WARC-Payload-Digest"] == "sha1:" + f["sha1"] for f in found if f["WARC-Type"] == "response")
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"]) and f["Content-Type"].startswith("application/http") for f in found)
    ids = collections.Counter(f["WARC-Record-ID"] for f in found)
    assert all(f["WARC-Refers-To"] in ids for f in found if f["WARC-Type"] == "revisit") and max(ids.values()) == 1
    warc.export(table, str(folder))  # again: the same files, no record twice
    assert sum(len(list(warc.read_file(path.open("rb")))) for path in folder.iterdir()) == len(pages)
    assert warc.read_back(storage.written(warc.records(df.limit(0)), "t")).count() == 0


def jaccard_components(rows, n, num, den):
    sets, parent = {}, {}
    for i, t in ((r[0], r[1]) for r in rows if r[0] is not None):
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_ngram_join_equals_brute_force(spark, docs, rows, n, num, den):
    expected = jaccard_components(rows, n, num, den)
    got = ngram_join.link_components(docs, n, num, den).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == expected[r.id] for r in got if r.id is not None)
    assert all(r.component_id is None for r in got if r.id is None)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.link_components(empty(spark)).count() == 0


def test_signature_trees_find_every_pair():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(120):
        s = np.unique(rng.integers(0, 1 << 62, rng.integers(3, 60)).astype(np.uint64))
        sets.append(s)
        for _ in range(rng.integers(0, 3)):
            sets.append(np.unique(np.concatenate([s[rng.random(len(s)) > 0.07], rng.integers(0, 1 << 62, 1).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    bits, slack = signature_tree.exact(sets)
    joined, all_ = signature_tree.Joined(len(sets)), np.arange(len(sets))
    tree = signature_tree.Tree(bits, sizes, slack)
    signature_tree.join(tree, tree, joined, all_, all_, 4, 5)
    parent = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    assert joined.label.tolist() == parent


def test_long_words_that_clash_as_polynomials_are_apart(spark):
    fold = "a"
    for _ in range(11):
        fold += fold.translate(str.maketrans("ab", "ba"))
    pair = [fold, fold.translate(str.maketrans("ab", "ba"))]
    sums = [textkit.span_hashes(textkit.prefix_sums(np.frombuffer(x.encode(), dtype=np.uint8)), np.array([0]), np.array([len(x)]))[0] for x in pair]
    assert sums[0] == sums[1]  # why long words have another hash
    rows = [(k, f"{x} and some other words") for k, x in enumerate(pair, 1)]
    got = {r.id: r.component_id for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == {1: 1, 2: 2}


def test_a_large_group_of_near_copies_of_one_size(spark):
    rng = random.Random(14)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(6000):
        words = list(base)
        words[rng.randrange(60)] = f"x{rng.randrange(3000)}"
        texts.append((k, " ".join(words)))
    texts += [(9000 + k, " ".join(f"y{k}_{j}" for j in range(60))) for k in range(50)]
    got = {r.id: r.component_id for r in ngram_join.link_components(spark.createDataFrame(texts, "doc_id long, text string"), 3, 8, 10).collect()}
    assert {got[k] for k, _ in texts[:6000]} == {0} and all(got[k] == k for k, _ in texts[6000:])


def test_components_by_contraction(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    df = spark.createDataFrame(edges, "a long, b long")
    whole = {r.node: r.root for r in graph.components(df).collect()}
    monkeypatch.setattr(graph, "ONE_TASK", 20)
    assert {r.node: r.root for r in graph.components(df).collect()} == whole
    assert whole[1040] == 1000


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu, one</a></li></ul></nav><div class="cookie-notice">We use cookies, always.</div>
<div class="content"><h2>Title &amp; more</h2><p>First, paragraph with   some words, and commas, to score well here.<p>Second &lt;one&gt;&nbsp;has <b>bold</b>, <a href="x">link</a><br>text, and is long enough to count.
<div class="ad">Buy, now, this, thing, please, today.</div><form><input><p>Sign up, for, news</p></form><ul><li>Item one, of the list</li><li>Item two</li></ul></div>
<aside class="sidebar"><p>Related, stories, that nobody, asked for, at all.</p></aside><section id="comments"><p>Reader, says, something, long, and, silly, with, commas, everywhere, in it.</p></section>
<footer><p>&copy; Site, all rights, reserved.</p></footer></body></html>"""


def test_html_main_text(spark):
    expected = "Title & more\nFirst, paragraph with some words, and commas, to score well here.\nSecond <one> has bold, link text, and is long enough to count.\nItem one, of the list\nItem two"
    assert html_text.main_text(PAGE) == expected
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "plain words, without any tag"), (6, "u", "<div>" * 3000 + "deep, text, here, for long enough a line" + "</div>" * 10), (1, "u", PAGE)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == [expected] * 2
    assert all(r.text == "" for r in got if r.page_id in (2, 3))


def test_html_keeps_the_whole_article():
    long = "".join(f"<p>Paragraph {k}, of some length, with commas, and words enough to score well in this page.</p>" for k in range(12))
    inner = f'<h1>The title</h1><div class="content">{long}</div><h2>Part two</h2><blockquote>A quoted line</blockquote><pre>x = 1</pre><section><p>A short end</p></section><div><a href="/a">See this</a> <a href="/b">See that</a></div>'
    for page in (f"<body><article>{inner}</article></body>", f"<body><main><div>{inner}</div></main></body>", f"<body><article><section>{inner}</section></article></body>"):
        lines = html_text.main_text(page).split("\n")
        assert [x for x in lines if not x.startswith("Paragraph")] == ["The title", "Part two", "A quoted line", "x = 1", "A short end"]
        assert lines[0] == "The title" and len(lines) == 17


def pages(rng, count):
    """(html, main text): articles in many wrappings, among all that is no article."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 10)))
    some = lambda a, b: " ".join(word() + rng.choice(["", "", "", ","]) for _ in range(rng.randrange(a, b))) + "."
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
    for _ in range(count):
        title, blocks, lines = some(3, 9), [], []
        for k in range(rng.randrange(4, 14)):
            kind = rng.choice(["p", "p", "p", "p", "h2", "blockquote", "ul", "pre", "refs", "open"])
            text = some(15, 60) if kind in ("p", "blockquote", "open") else some(2, 7)
            if kind == "ul":
                items = [some(5, 15) for _ in range(3)]
                blocks.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
                lines += items
            elif kind == "refs":
                names = [word() for _ in range(3)]
                blocks.append("<h3>Sources</h3><ol>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in names) + "</ol>")
                lines += ["Sources", *names]
            else:
                tag = "p" if kind == "open" else kind
                blocks.append(f"<{tag}>{text.replace(' ', ' <i>', 1).replace(' ', '</i> ', 2) if kind == 'p' and k % 3 == 0 else text}" + ("" if kind == "open" else f"</{tag}>"))
                lines.append(text)
        inner = "".join(blocks)
        form = rng.randrange(6)
        body = [
            f"<article><h1>{title}</h1>{inner}</article>",
            f'<main><header><h1>{title}</h1></header><div class="entry-content">{inner}</div></main>',
            f'<article class=post data-t=it\'s><header class="article-header"><h1>{title}</h1></header><section>{inner}</section></article>',
            f'<div id="content"><h1>{title}</h1>{inner}</div>',
            f'<div class="page has-sidebar"><div class="story"><h1>{title}</h1>{inner}</div></div>',
            f"<main><article><h1>{title}</h1><div>{inner}</div></article></main>",
        ][form]
        noise = [
            f"<nav><ul>{links(5)}</ul></nav>", f'<div class="main-nav"><ul>{links(6)}</ul></div>', f'<header><div class=logo>{some(2, 5)}</div></header>', f'<div class="cookie-notice">{some(9, 20)}</div>',
            f'<div class="ad">{some(5, 20)}</div>', f"<aside><p>{some(20, 40)}</p></aside>", f'<div class="sidebar"><p>{some(10, 40)}</p><ul>{links(4)}</ul></div>', f"<form><p>{some(5, 10)}</p><input></form>",
            f'<script>var a = "<p>{some(9, 20)}</p>";</script>', "<style>p{margin:0}</style>", f"<!-- {some(5, 9)} -->",
        ]
        after = [f"<footer><p>{some(5, 20)}</p></footer>", f'<section id="comments"><p>{some(20, 60)}</p><p>{some(20, 60)}</p></section>', f'<div class="site-footer">{some(4, 9)}</div>', f'<ul class="social-share">{links(4)}</ul>']
        yield "<html><head><title>t</title></head><body>" + "".join(rng.sample(noise, 4)) + body + "".join(rng.sample(after, 2)) + "</body></html>", "\n".join([title, *lines])


def test_html_of_labelled_pages():
    made = list(pages(random.Random(17), 300))
    got = [html_text.main_text(page) for page, _ in made]
    lines = [(set(g.split("\n")), set(t.split("\n"))) for g, (_, t) in zip(got, made)]
    found, right = sum(len(g & t) for g, t in lines), sum(len(t) for _, t in lines)
    assert found / right > 0.98 and found / sum(len(g) for g, _ in lines) > 0.98
    assert sum(g == t for g, (_, t) in zip(got, made)) / len(made) > 0.9


def test_html_names_attributes_and_depth():
    long = "".join(f"<p>Paragraph {k}, of some length, with commas, and words enough to score well in this page.</p>" for k in range(5))
    assert html_text.main_text(f"<body data-t=it's>{long}</body>").count("\n") == 4
    assert html_text.main_text(f'<main><header><h1>Head</h1></header><div class="side-by-side"><p>Left, here.</p></div>{long}</main>').startswith("Head\nLeft, here.\n")
    assert html_text.main_text("<p title=\"a > b\" data-x='<p>'>One, two</p><p title=\"open>Three</p>") == "One, two\nThree"
    deep = "<div>" * 30_000 + "deep, text, here, for long enough a line" + "</div>" * 30_000
    assert html_text.main_text(deep) == "deep, text, here, for long enough a line"


def repeats(texts):
    seen = collections.Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        out.append(gone)
    return out


def test_suffix_dedup_equals_brute_force(spark, docs, rows):
    texts = [(r[1] or "").encode() for r in rows]
    gone = repeats(texts)
    expected = collections.Counter()
    for r, t, g in zip(rows, texts, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        expected[(r[0], len(t), sum(g), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert collections.Counter(tuple(x) for x in suffix_dedup.digests(docs).collect()) == expected
    assert suffix_dedup.removed(docs).columns == docs.columns
    assert suffix_dedup.digests(empty(spark)).count() == 0


def test_multikey_order_is_lexicographic():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    assert words[suffix_dedup.multikey_order(words)].tolist() == sorted(words.tolist())


def test_long_texts_come_in_pieces(monkeypatch):
    rng = random.Random(9)
    block = bytes(rng.randrange(256) for _ in range(900))
    text = block + bytes(rng.randrange(256) for _ in range(5000)) + block
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 10)
    place, token = (np.concatenate(x).tolist() for x in list(zip(*suffix_dedup.anchors([text])))[1:3])
    assert len(place) == len(set(place))
    assert all(any(s <= p <= s + suffix_dedup.LEFT for p in place) for s in range(len(text) - 199))
    at = collections.defaultdict(set)
    for p, t in zip(place, token):
        at[t].add(p)
    shared = {min(ps) for ps in at.values() if len(ps) > 1}
    assert all(any(s <= p <= s + suffix_dedup.LEFT for p in shared) for s in range(len(block) - 199))


def removed_by(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(df).collect()}


@pytest.mark.parametrize("piece", [1 << 20, 1 << 11])
def test_periodic_stretches_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(piece)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = ["x" * 200, "x" * 199 + "y", "x" * 201, noise(300) + "x" * 5000 + noise(300), "ab" * 1500, "b" + "ab" * 100, noise(40) + "abc" * 900 + noise(40) + "ab" * 99 + "a"]
    texts += ["q" * 199, "z" * 200, noise(50) + "y" * 400 + "x" * 400, "abcab" * 300 + "abcabcab" * 200, (noise(90) + "\n") * 40, noise(170) * 30, "é" * 500, noise(5000)]
    for _ in range(40):
        texts.append("".join(rng.choice(["x", "ab", "abc", "x" * 210, "ab" * 130, "abc" * 80, noise(30), noise(250)]) * rng.choice([1, 1, 2, 90]) for _ in range(rng.randrange(1, 8))))
    data = [t.encode() for t in texts]
    expected = {}
    for k, (t, g) in enumerate(zip(data, repeats(data))):
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        expected[k] = (sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(t, g) if not x)).hexdigest())
    assert removed_by(spark, texts) == expected


def test_long_periodic_texts_have_few_anchors():
    for t in (b"x" * 3_000_000, b"word " * 600_000, b"line of a table | 0 | 0 |\n" * 100_000):
        got = [np.concatenate(x) for x in zip(*suffix_dedup.anchors([t]))]
        assert len(got[0]) < 2000 and got[4].max() == len(t)


def test_suffix_dedup_keeps_columns_of_any_name(spark):
    text = "some words that stand twice " * 10
    df = spark.createDataFrame([(1, text, "a", 5, [1], "k"), (2, text, "b", 6, [2], "k"), (3, "own", "c", 7, [3], "k")], "doc_id long, text string, _id string, _chk int, spans array<int>, id string")
    got = {r.doc_id: r for r in suffix_dedup.removed(df).collect()}
    assert suffix_dedup.removed(df).schema == df.schema
    assert [tuple(got[k]) for k in (1, 3)] == [(1, "", "a", 5, [1], "k"), (3, "own", "c", 7, [3], "k")]
    assert {r.doc_id: r.n_removed for r in suffix_dedup.digests(df).collect()} == {1: len(text), 2: len(text), 3: 0}


def check_packing(out, lengths, sizes):
    assert sorted(x for x in out.groupby("doc_id")["n_tokens"].sum()) == sorted(sizes)
    for (_, _), part in out.groupby(["pack_group", "bin"]):
        part = part.sort_values("slot")
        capacity, used = part["capacity"].iloc[0], part["n_tokens"].sum()
        assert capacity in lengths and used <= capacity and not any(used <= c < capacity for c in lengths)
        assert part["offset"].tolist() == (part["n_tokens"].cumsum() - part["n_tokens"]).tolist()


def test_packing(spark, docs, rows):
    rng = random.Random(8)
    sizes = [rng.choice([1, 7, 100, 511, 513, 5000, 30_000]) for _ in range(400)]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "doc_id long, n long")
    check_packing(packing.pack(df, length=F.col("n")).toPandas(), packing.LENGTHS, sizes)
    got = packing.pack(docs).toPandas()
    assert got["n_tokens"].sum() == sum(len(WORD.findall(r[1] or "")) + 1 for r in rows)
    assert packing.pack(empty(spark)).count() == 0


def test_best_fit_takes_the_tightest_bin():
    where, capacity, _ = packing.best_fit([600, 500, 400, 300, 100], (1000,), 1.0)
    assert where == [0, 1, 0, 1, 1] and capacity == [1000, 1000]


def plainly_best_fit(sizes, lengths, factor):
    """Every open bin is looked at for every piece; of bins with equal room the one that got it last."""
    bins, where = [], []  # room, when, used
    for when, n in enumerate(sizes):
        fits = [b for b in range(len(bins)) if bins[b][0] >= n]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0], -bins[b][1]))
            bins[b] = [bins[b][0] - n, when, bins[b][2] + n]
        else:
            b = len(bins)
            able = [c for c in lengths if c >= n and c >= min(lengths[-1], factor * n)]
            room = min(able, key=lambda c: packing.cost(c) / (c // n * n) if factor > 1 else packing.cost(c))
            bins.append([room - n, when, n])
        where.append(b)
    return where, [min(c for c in lengths if c >= used) for _, _, used in bins]


def test_best_fit_equals_a_plain_one():
    rng = random.Random(21)
    for lengths in ((512, 1024, 2048, 4096, 8192), (10, 16), (7,)):
        for _ in range(15):
            sizes = sorted((rng.choice([1, 2, lengths[0], rng.randrange(1, lengths[-1] + 1)]) for _ in range(rng.randrange(1, 150))), reverse=True)
            plain = {f: plainly_best_fit(sizes, lengths, f) for f in packing.FACTORS}
            for f in packing.FACTORS:
                assert packing.best_fit(sizes, lengths, f)[:2] == plain[f]
            cheapest = min(packing.FACTORS, key=lambda f: sum(map(packing.cost, plain[f][1])))
            assert packing.packed_group(np.array(sizes), lengths) == plain[cheapest]


def test_packing_deals_repeated_ids_evenly(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    df = spark.createDataFrame([(1 if k % 3 else None, 1 + k % 700) for k in range(3000)], "doc_id long, n long").withColumn("pack_group", F.lit("clash"))
    out = packing.pack(df, length=F.col("n")).toPandas()
    assert out["n_tokens"].sum() == sum(1 + k % 700 for k in range(3000)) and len(out) == 3000
    assert out.groupby("pack_group").size().max() < 200


def weighted_windows(items, text):
    """Items whose weighted shingles reach the threshold with some window of the item's length, by trying every window."""
    cut = lambda t: decontam.plain(t).split()
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in items if t and len(w := cut(t)) >= 5}
    df = collections.Counter(x for s in sets.values() for x in s)
    weight = lambda s: sum(1 / (1 + math.log(df[x])) if df[x] else 1.0 for x in s)
    words, out = cut(text or ""), set()
    for i, t in items:
        if i in sets:
            m = len(cut(t))
            for s in range(max(1, len(words) - m + 1)):
                w = words[s : s + m]
                own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
                both = weight(own & sets[i])
                if both and both / (weight(own) + weight(sets[i]) - both) >= 0.8:
                    out.add(i)
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(33)
    base = [prose(rng, rng.randrange(8, 70), 3000) for _ in range(14)]
    items = list(enumerate(base + [base[0] + " more words", base[1], " ".join(base[2].split()[:30]), base[3] + " " + base[4]]))
    texts = []
    for k in range(70):
        words = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(["other", "new thing", ""])
        text = " ".join(words)
        texts.append(f"{prose(rng, rng.randrange(60), 3000)} {rng.choice([text, text.upper(), text.replace(' ', ', ')])} {prose(rng, rng.randrange(60), 3000)}")
    texts += [texts[0], texts[0], None, "", prose(rng, 20_000, 3000) + " " + base[5]]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, hits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: {h.item_id for h in r.hits} for r in decontam.scanned(docs, bench).collect()}
    assert got == {k: weighted_windows(items, t) for k, t in enumerate(texts)}
    kept = decontam.clean(docs, bench)
    assert kept.schema == docs.schema and {(r.doc_id, r.hits) for r in kept.collect()} == {(k, "x") for k in got if not got[k]}


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randrange(5, 60), 5000)) for k in range(30)] + [(30, "tiny item"), (31, None), (32, " ")]
    docs, expected = [], {}
    for k in range(60):
        text, found = prose(rng, 200, 5000), set()
        if k % 3 == 0:
            i, t = items[k // 3]
            words = t.split()
            if k % 2 and len(words) > 45:
                words[20] = "other"
            text, found = f"{text} {' '.join(words).upper()} {prose(rng, 40, 5000)}", {i}
        docs.append((k, text))
        expected[k] = found
    docs += [(100, None), (101, ""), (102, "tiny item")]
    expected |= {100: set(), 101: set(), 102: {30}}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: {h.item_id for h in r.hits} for r in decontam.scanned(df, bench).collect()}
    assert got == expected
    assert decontam.scanned(df.limit(0), bench).count() == 0 and decontam.clean(df, bench.limit(0)).count() == len(docs)


def test_decontamination_finds_short_items_and_items_without_an_id(spark):
    rng = random.Random(8)
    long = prose(rng, 30, 5000)
    bench = spark.createDataFrame([(1, "Tiny item"), (2, "four words of it"), (None, long), (3, "one"), (None, "rare pair")], "item_id long, text string")
    texts = [f"{prose(rng, 40)} tiny, ITEM {prose(rng, 40)} tiny item", "tiny", f"{prose(rng, 9)} four words of it", f"{prose(rng, 9)} {long}", "four words of", None, f"x one {prose(rng, 5)} rare pair"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(h.item_id, h.start_word, h.n_words) for h in r.hits] for r in decontam.scanned(docs, bench).collect()}
    assert got == {0: [(1, 40, 2)], 1: [], 2: [(2, 9, 4)], 3: [(None, 9, 30)], 4: [], 5: [], 6: [(3, 1, 1), (None, 7, 2)]}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {1, 4, 5}


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    index = decontam.Index([(k, " ".join(f"a{rng.integers(999)}" for _ in range(30))) for k in range(50)])
    for k in range(50):
        bits = np.unpackbits(index.prints[k])
        bits[rng.choice(64, decontam.RADIUS, replace=False)] ^= 1
        assert k in index.within(np.packbits(bits))


def test_word_kernel():
    texts = [b"A b\tC", b"", b"one", b"\xc3\x89 x"]
    words = textkit.Words(texts)
    assert words.n.tolist() == [3, 0, 1, 2]
    assert textkit.Words([b"a"]).hash[0] == words.hash[0]
    h, first = words.shingles(2)
    assert np.diff(first).tolist() == [2, 0, 1, 1]


def test_pipeline_equals_its_brute_force(spark, rows, tmp_path):
    import corpus_pipeline

    table = [r[:5] for r in documents()]
    rng = random.Random(12)
    item = prose(rng, 40, 9000)
    table.append((500, f"{prose(rng, 120, 9000)} {item}", "en", "s", 0))
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    ledger = {r.doc_id: r for r in quality.apply_policy(quality.ledger(spark.read.parquet(f"{tmp_path}/documents.parquet"))).collect()}
    kept = [r for r in table if ledger[r[0]].kept]
    components = jaccard_components(kept, 5, 4, 5)
    kept = [r for r in kept if components[r[0]][1] == r[0]]
    gone = repeats([r[1].encode() for r in kept])
    sizes = {r[0]: len(WORD.findall(bytes(b for b, x in zip(r[1].encode(), g) if not x).decode("utf-8", "ignore"))) + 1 for r, g in zip(kept, gone) if r[0] != 500}
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]


def test_pipeline_keeps_one_of_repeated_rows_and_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    texts = [prose(rng, 150, 9000) for _ in range(6)]
    near = texts[3].split()
    near[70] = "changed"
    row = lambda k, t: (k, t, "en", "s", 0)
    table = [row(1, texts[0])] * 3 + [row(None, texts[1])] * 3 + [row(2, texts[2]), row(None, texts[2]), row(None, texts[3]), row(None, " ".join(near)), row(5, texts[4]), row(4, texts[4]), row(4, texts[5])]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, prose(rng, 40, 9000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.ngram_jaccard(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    got = collections.Counter((r.doc_id, texts.index(r.text) if r.text in texts else 3) for r in stage.collect())
    assert got == {(1, 0): 1, (None, 1): 1, (2, 2): 1, (None, 3): 1, (4, 4): 1, (4, 5): 1}
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert packed["n_tokens"].sum() == 6 * 151
