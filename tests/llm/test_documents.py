"""The document operators against plain sequential versions, on awkward rows and on the smallest table."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from seatwise.llm import imatch, licenses, minhash_join, mixing, packing, quality, sharding
from seatwise.llm.common import running, table
from seatwise.llm.components import components
from seatwise.llm.queries import TOKENIZER
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = WORD.findall(lower(text))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def groups(sets):
    """The least id reachable, by brute force over all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    want = groups(sets)
    for r in minhash_join.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_awkward_rows(documents, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_join.near_duplicates(documents).collect()}
    assert got[1] == (12, 1) and got[2] == (12, 1) and got[3] == (13, 1)
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[10] == (0, 10)
    assert got[7][1] == got[8][1] == got[9][1] == 7 and got[None][1] is None
    assert minhash_join.near_duplicates(nothing).count() == 0
    once = [r.doc_id for r in minhash_join.one_of_each(documents).collect()]
    assert sorted(once, key=str) == sorted([1, 4, 5, 6, 7, 10, 11, 12, None], key=str)


def test_links_between_texts_that_miss_the_first_of_their_list(spark):
    base = [f"a{i}" for i in range(200)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1:]) for i in range(0, 200, 2)] + [" ".join(base[20:]), " ".join(base[40:] + base[:5])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = groups({i: shingles(t) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in minhash_join.near_duplicates(docs).collect()} == want


def test_a_family_just_below_the_threshold_is_not_compared_in_pairs(spark, monkeypatch):
    """80 edits of one text, most of them linked by none: nearly all 3,160 pairs used to be taken to the full sets."""
    draw = random.Random(7)
    texts = []
    for i in range(80):
        words = [f"a{k}" for k in range(300)]
        for k in draw.sample(range(300), 6):
            words[k] = f"x{i}" if k % 2 else "y"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = groups({i: shingles(t) for i, t in enumerate(texts)})
    compared, write = [], minhash_join.written

    def counted(df, name, *by):
        out = write(df, name, *by)
        if name == "crossing":
            compared.append(out.count())
        return out

    monkeypatch.setattr(minhash_join, "written", counted)
    assert {r.doc_id: r.component_id for r in minhash_join.near_duplicates(docs).collect()} == want
    assert len(set(want.values())) > 20 and sum(compared) < 300


def test_texts_stay_in_place_where_few_are_wanted(spark, documents):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the wanted ids were many
    try:
        sets = minhash_join.full_sets(documents, "doc_id", "text", spark.createDataFrame([(1,), (7,), (7,), (99,)], "node long"))
        plan = sets._jdf.queryExecution().executedPlan().toString()
        found = {r.node: len(r.shingles) for r in sets.where("node in (1, 7)").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and found == {1: 12, 7: 1}


def test_components_of_chains_and_stars(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links + [(7, 7), (None, 3)], "a long, b long"), "a", "b").collect()}
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        assert got[node] == min(seen)
    assert set(got) == set(near)


def test_running_totals(spark):
    rows = [(k, i, i % 5) for k in "ab" for i in range(300)]
    df = running(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], {"before": "v"}, ["i"])
    for k in "ab":
        own = sorted((r.before, r.v) for r in df.where(f"k = '{k}'").collect())
        assert [b for b, _ in own][0] == 0 and sum(v for _, v in own) == own[-1][0] + own[-1][1] == 600


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_packing_is_an_exact_round_trip(spark, documents, which):
    docs = table(spark, SF, "documents") if which == "table" else documents
    pieces = packing.pack(docs, TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want, got = Counter(), Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 2048):
            part = ids[start:start + 2048]
            want[r.doc_id, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids)] += 1
    held = defaultdict(list)
    for p in pieces:
        got[p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens] += 1
        held[p.sequence_id].append((p.offset, p.length))
    assert got == want
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    if which == "table":
        assert sum(p.length for p in pieces) > 0.97 * 2048 * len(held)


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, TOKENIZER).count() == 0


def test_tokens_of_odd_words_equal_the_tokenizer():
    tokenizer, words, draw = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER), random.Random(5)
    for _ in range(400):
        text = "".join(draw.choice("abAB zZéÉİΣσ '.,!?#&1٢中 \n\tẞ한́_-’") for _ in range(30)) + " it's we'll.. "
        assert words.batch([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_worker_keeps_few_words_whatever_it_reads():
    store = packing.WordIds(TOKENIZER)
    for first in range(0, 400_000, 40_000):
        store.batch([" ".join([f"w{i}" for i in range(first, first + 40_000)]).encode()])
        assert len(store.places) <= 200_000


def test_added_tokens_inside_a_text_equal_the_tokenizer(spark):
    tokenizer, words, draw = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER), random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDoftext|>", "<|endoftext", "|>", " ", "\n", "a", "It's", "É", "\u0338", "\u0301", "don't.", "٢", "<"]
    texts = ["one <|endoftext|> two", "one <|ENDOFTEXT|> two", "<|endoftext|>", "<|startoftext|>a<|endoftext|><|endoftext|>"]
    texts += ["".join(draw.choice(parts) for _ in range(12)) for _ in range(300)]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert want[0] == [637, 49407, 1237]
    flat, bounds = words.batch([text.encode() for text in texts])
    assert [flat[bounds[i]:bounds[i + 1]].tolist() for i in range(len(texts))] == want
    words.clear()
    assert words.batch([texts[3].encode()])[0].tolist() == want[3]
    piece, = packing.pack(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), TOKENIZER).collect()
    ids = [*want[0], 1]
    assert (piece.doc_tokens, piece.ids_crc32) == (4, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))


def goals(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_mix_reaches_its_targets(spark, documents, which):
    docs = table(spark, SF, "documents") if which == "table" else documents
    source = {(r.doc_id, len(WORD.findall(r.text or ""))): r.source for r in docs.collect()}
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want, taken = goals(sizes), Counter()
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        name = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[name] and r.target == pytest.approx(want[name]) and 0 <= r.taken <= 3 * r["size"]
        taken[name] += r.taken
    for name in sizes:
        assert abs(taken[name] - want[name]) <= 1
    assert Counter(rows) == Counter(mixing.mix(docs.repartition(7)).collect())


def test_mix_stage_repeats_documents(documents, nothing):
    taken = Counter()
    for r in mixing.mix(documents).collect():
        taken[r.doc_id] += -(-r.taken // max(r["size"], 1))
    again = mixing.repeat(documents)
    assert again.columns == documents.columns
    assert Counter(r.doc_id for r in again.collect()) == Counter({k: v for k, v in taken.items() if v})
    assert mixing.mix(nothing).count() == mixing.repeat(nothing).count() == 0


def test_shards_are_even_and_keep_copies(spark, documents, nothing):
    rows = sharding.shard_documents(table(spark, SF, "documents")).collect()
    load, slots, held = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        held[r.text_crc32].add(r.shard)
    assert len(load) == 16 and max(load.values()) < 1.1 * sum(load.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) - 1 for s in held.values()) <= 2
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = sharding.shard_documents(documents).collect()
    assert len(rows) == documents.count()
    assert all((r["size"], r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    assert sharding.shard_documents(nothing).count() == 0


def test_one_large_group_of_copies_is_split_evenly(spark):
    rows = [(i, "copy " * 20) for i in range(300)] + [(1000 + i, f"text {i} " * (i % 9 + 1)) for i in range(300)]
    load = Counter()
    for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        load[r.shard] += r["size"]
    assert max(load.values()) < 1.05 * sum(load.values()) / 16


def test_pairs_stay_together_when_all_rows_have_copies(spark):
    rows = [(i, f"text {i // 2:05d}") for i in range(3000)] + [(5000 + i, "hot number") for i in range(1500)]
    load, held = Counter(), defaultdict(set)
    for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        load[r.shard] += r["size"]
        held[r.text_crc32].add(r.shard)
    hot = held.pop(zlib.crc32(b"hot number"))
    assert all(len(shards) == 1 for shards in held.values()) and len(hot) <= 16
    assert sum(load.values()) == 11 * 4500 and max(load.values()) < 1.05 * sum(load.values()) / 16


def test_edited_texts_and_fingerprints(spark, documents, nothing):
    import hashlib
    for docs in (table(spark, SF, "documents"), documents):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = Counter()
        for i, (doc, text) in enumerate(rows):
            cut = len(text) // 3
            after = rows[(i + 1) % len(rows)][1]
            want[doc, len(text), hashlib.sha256((text[:len(text) - cut] + after[:cut]).encode()).hexdigest()] += 1
        got = imatch.fingerprints(docs).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        texts, seen = dict(rows), {}
        for r in got:
            assert seen.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        if docs is not documents:
            assert sum(r.near_edited for r in got) > 10 * sum(r.near_next for r in got)
    assert imatch.fingerprints(nothing).count() == 0


def test_fingerprints_where_copies_and_edited_copies_are_a_third_of_the_rows(spark):
    draw = random.Random(11)
    text = [f"hot{i}" for i in range(120)]
    rows = [(i, " ".join(text)) for i in range(20)]
    rows += [(20 + i, " ".join(text[:i * 3] + [f"own{i}x{j}" for j in range(6)] + text[i * 3 + 6:])) for i in range(30)]
    rows += [(100 + i, " ".join(f"w{draw.randrange(4000)}" for _ in range(100))) for i in range(100)]
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.fingerprint.startswith("text:") for r in got.values())
    assert len({got[i].fingerprint for i in range(20)}) == 1
    assert all(got[i].near_next >= 0.25 for i in range(1, 50))
    assert sum(got[i].near_edited for i in range(1, 50)) > 10 * sum(got[i].near_next for i in range(101, 200))
    assert sum(got[i].near_next for i in range(101, 200)) < 0.1 * 99
    alone = spark.createDataFrame([(i, f"rare{i} one{i} two{i} three{i} four{i} five{i}") for i in range(9000)], "doc_id long, text string")
    assert not any(r.fingerprint.startswith("text:") for r in imatch.fingerprints(alone).collect())


def test_license_places_equal_brute_force(spark, documents, nothing):
    for docs in (table(spark, SF, "documents"), documents):
        for r, d in zip(sorted(licenses.scan(docs).collect(), key=lambda r: (str(r.doc_id), r.n_words)),
                        sorted(docs.collect(), key=lambda r: (str(r.doc_id), len(r.text or ""))), strict=True):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d.text))
            places, labels = [], set()
            for phrase, label in licenses.PHRASES:
                parts = phrase.split()
                found = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
                places += found
                labels |= {label} if found else set()
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
                len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
            assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
            # Every rule on its own, then suppression, over the same words.
            spans = set()
            text = " " + " ".join(words) + " "
            for rule in licenses.rules():
                if rule["keyword"] in text:
                    for hit in re.finditer(rule["pattern"], text):
                        first = text[:hit.start()].count(" ") - 1
                        spans.add((first, first + hit[0].count(" "), rule["priority"], -rule["score"], rule["label"]))
            kept = {s for s in spans if not any(o[0] <= s[0] and o[1] >= s[1] and (o[1] - o[0] > s[1] - s[0] or o[2:] < s[2:]) for o in spans)}
            assert set(r.labels.split(",")) - {""} == labels | {s[4] for s in kept}
    assert licenses.scan(nothing).count() == 0


def test_suppression_and_labels(documents):
    found = {r.doc_id: r for r in licenses.scan(documents).collect()}
    assert found[12].base_labels == "apache,cc-by,mit" and found[12].labels == "apache,apache-2.0,cc-by,mit" and found[12].score == 0.95
    assert found[4].n_words == 0 and found[4].labels == "" and found[4].first_word is None


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score_documents(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r.predicted == known[r.doc_id] for r in rows if r.held_out and r.doc_id in known]
    assert sum(judged) / len(judged) >= 0.95


def test_quality_without_labels_and_of_awkward_rows(spark, documents, nothing):
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.score_documents(documents, labels).collect()} == {(0.5, 0)}
    assert quality.score_documents(nothing, labels).count() == 0
    good = spark.createDataFrame([(i, 1) for i in range(1, 13)], "doc_id long, quality int")
    kept = quality.accepted(documents, good)
    assert kept.columns == documents.columns and kept.count() == documents.count()
