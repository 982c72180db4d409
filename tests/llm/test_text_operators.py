"""Operators 1, 2, 5, 6, 9 and 10 against brute force on small fixtures, and their odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepwise.llm import fingerprints, jaccard_join, packing, pieces, quality_rules, repeats
from stepwise.llm.common import stored
from stepwise.llm.queries import op1_suffix_dedup, op5_quality_rules, op10_ngram_jaccard_join, vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# --- 1: repeated byte strings -------------------------------------------------------------------

def brute_repeats(rows, depth=100):
    """(id, text) -> removed byte flags; rows that share a doc_id are one document each."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, text in order:
        b = text.encode()
        for j in range(len(b) - depth + 1):
            key = (i is None, i or 0)
            w = b[j : j + depth]
            if w not in first or key < first[w][0]:
                first.setdefault(w, (key, j))
    out = {}
    for i, text in order:
        b, key = text.encode(), (i is None, i or 0)
        gone, own = bytearray(len(b)), set()
        for j in range(len(b) - depth + 1):
            w = b[j : j + depth]
            if first[w][0] < key or w in own:
                gone[j : j + depth] = b"\x01" * depth
            own.add(w)
        out[i, text] = gone
    return out


def check_repeats(docs):
    want = brute_repeats(docs_of(docs))
    got = repeats.without_repeats(docs, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        gone, b = want[r.doc_id, r.text or ""], (r.text or "").encode()
        assert bytes(r.kept) == bytes(x for x, g in zip(b, gone, strict=True) if not g), r.doc_id
        spans = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(gone))]
        assert [(s.start, s.end) for s in r.spans] == spans


@pytest.mark.parametrize("large", [20_000, 3])
def test_repeats_match_brute_force(spark, odd_docs, monkeypatch, large):
    monkeypatch.setattr(repeats, "LARGE", large)  # with 3, common grams take the way for large groups
    check_repeats(odd_docs)


def test_no_texts_have_no_repeats(spark, no_docs):
    assert repeats.without_repeats(no_docs, ["doc_id"]).count() == 0


def test_repeats_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_repeats(docs_of(docs))
    by_id = {i: (t, g) for (i, t), g in want.items()}
    for r in op1_suffix_dedup(spark, SF).collect():
        text, gone = by_id[r.doc_id]
        kept = bytes(x for x, g in zip(text.encode(), gone, strict=True) if not g)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(text.encode()), sum(gone), hashlib.sha256(kept).hexdigest())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=400), st.integers(20, 60))
def test_runs_hold_every_window_once(numbers, depth):
    text = bytes(97 + n for n in numbers)
    _, place, _, _ = repeats.runs([text], depth, gram=12)
    windows = [w for p in place.tolist() for w in range(p // repeats.RUN, p // repeats.RUN + p % repeats.RUN + 1)]
    assert sorted(windows) == list(range(max(0, len(text) - depth + 1)))


def test_long_texts_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    text = b"".join(hashlib.md5(bytes([i % 5])).hexdigest().encode() for i in range(200))
    _, place, _, _ = repeats.runs([text, text[:90], text[50:300]])
    assert sum(p % repeats.RUN + 1 for p in place.tolist()) == len(text) - 99 + 250 - 99


# --- 2: fingerprints ----------------------------------------------------------------------------

def shingle_set(text, fold=False):
    w = WORD.findall(text.translate(FOLD) if fold else text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_fingerprints_follow_the_jaccard_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs_of(docs))
    got = {r.doc_id: r for r in fingerprints.compare_edits(docs).collect()}
    errors = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(text)
        a, b, c = shingle_set(text), shingle_set(edited), shingle_set(after)
        errors += [got[i].near_edited - len(a & b) / len(a | b), got[i].near_next - len(a & c) / len(a | c)]
    assert max(map(abs, errors)) < 0.2 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.04


def test_fingerprints_of_odd_texts(spark, odd_docs, no_docs):
    rows = fingerprints.compare_edits(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_text = defaultdict(set)
    texts = defaultdict(set)
    for i, t in docs_of(odd_docs):
        texts[i].add(t)
    for r in rows:
        if len(texts[r.doc_id]) == 1:
            by_text[next(iter(texts[r.doc_id]))].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[""] == {""} and next(r for r in rows if r.doc_id == 3).near_next == 1.0
    assert fingerprints.compare_edits(no_docs).count() == 0


# --- 5: quality rules ---------------------------------------------------------------------------

def brute_base(text):
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[words[i], words[i + 1], words[i + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def check_quality(docs):
    got = quality_rules.judge(docs).collect()
    want = Counter((i, *brute_base(t)) for i, t in docs_of(docs))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_counters_match_brute_force(spark, odd_docs, no_docs):
    check_quality(odd_docs)
    check_quality(spark.read.parquet(f"{SF}/documents.parquet"))
    check_quality(no_docs)


def test_quality_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = op5_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.1 * len(bad)


# --- 6: pieces ----------------------------------------------------------------------------------

def brute_segment(own, chunk):
    """Best (score, minus pieces) over all segmentations, trying every substring."""
    by_text = {p: i for i, p in own.text.items()}
    best = [(0.0, 0)]
    for end in range(1, len(chunk) + 1):
        options = [(best[end - 1][0] + own.unknown, best[end - 1][1] - 1)]
        options += [(best[s][0] + own.scores[by_text[chunk[s:end]]], best[s][1] - 1) for s in range(end) if chunk[s:end] in by_text]
        best.append(max(options))
    return best[-1]


def test_viterbi_is_optimal():
    own = pieces.model(vocabulary("piece_bpe_32k.model"))
    for chunk in ("▁hello", "▁▁▁thentation", "▁日本語x", "ççñandú", "▁" * 5, "a", "▁antidisestablishment", "▁\u0fffx"):
        score, few = brute_segment(own, chunk)
        ids = own.viterbi(chunk)
        pieces_of = [own.scores[i] for i in ids if i in own.text]
        unknown = sum(1 for c in chunk if c not in own.text.values())
        assert sum(pieces_of) + own.unknown * unknown == pytest.approx(score)
        assert -few == len(pieces_of) + unknown


def test_pieces_round_trip(spark, odd_docs, no_docs):
    path = vocabulary("piece_bpe_32k.model")
    for r in pieces.decode(pieces.encode(odd_docs, path), path).collect():
        assert r.decoded == r.text.replace("▁", " ")
    assert pieces.decode(pieces.encode(no_docs, path), path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(text):
    own = pieces.model(vocabulary("piece_bpe_32k.model"))
    assert own.decode(own.encode(text)) == text.replace("▁", " ")


# --- 9: packing ---------------------------------------------------------------------------------

def tokenizer_ids(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [own.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_packing_holds_every_id_once(spark, odd_docs, no_docs):
    room = 64
    cut = stored(packing.token_pieces(odd_docs, vocabulary("word_bpe_49k.json"), room), "test-pieces")
    rows = packing.pack(cut, room, salts=3).collect()
    sequences = defaultdict(list)
    parts = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id, r.doc_tokens, r.start].append(bytes(r.ids))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    want = Counter()
    for (i, _), ids in zip(docs_of(odd_docs), tokenizer_ids([t for _, t in docs_of(odd_docs)]), strict=True):
        for s in range(0, len(ids), room):
            want[i, len(ids), s, b"".join(x.to_bytes(4, "little") for x in ids[s : s + room])] += 1
    assert Counter((*k, p) for k, ps in parts.items() for p in ps) == want
    assert packing.pack(stored(packing.token_pieces(no_docs, vocabulary("word_bpe_49k.json")), "none")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_is_best_fit_decreasing(histogram):
    room = 40
    open_rooms = []
    for length in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
        fits = [(left, i) for i, left in enumerate(open_rooms) if left >= length]
        if fits:
            open_rooms[min(fits)[1]] -= length
        else:
            open_rooms.append(room - length)
    steps = defaultdict(list)
    for length, *step in packing.plan(histogram, room):
        steps[length].append(step)
    used = defaultdict(list)
    for length, count in histogram.items():
        for q in range(count):
            rank, sequence, each, offset = [s for s in steps[length] if s[0] <= q][-1]
            used[sequence + (q - rank) // each].append((offset + (q - rank) % each * length, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    assert sorted(room - sum(n for _, n in p) for p in used.values()) == sorted(open_rooms)


def test_word_ids_equal_the_tokenizer():
    own = packing.word_ids(vocabulary("word_bpe_49k.json"))
    texts = ["Hello  World<|endoftext|> x's don't I'LL", "Á e ́x", "a\xa0b\u2003c\x0bd\x0ce\x85f\x1cg\u200bh", "ǅ İ ΑΣ Σ ŉx Ĳ 12a3 ½ a_b--c ßẞ",
             "'s's ''t", "STRASSE straße", "x²y"]
    for text, ids in zip(texts, tokenizer_ids(texts), strict=True):
        assert b"".join(own[w] for w in text.encode().split()) == b"".join(i.to_bytes(4, "little") for i in ids[:-1]), text


def test_every_character_near_the_plain_range_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), packing.WordIds(path)
    for c in (chr(i) for i in range(0x21, 0x260) if not chr(i).isspace()):
        for w in (c, c + "liyev", f"a{c}b", "kw" + c, f"x1{c}Y-{c}", c + c):
            want = whole.encode(w, add_special_tokens=False).ids
            assert own[w.encode()] == b"".join(i.to_bytes(4, "little") for i in want), (hex(ord(c)), w)


# --- 10: Jaccard join ---------------------------------------------------------------------------

def brute_components(rows):
    sets = [(i, shingle_set(t, fold=True)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(sets)):
        members[find(k)].append(sets[k][0])
    least = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return Counter((i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("short", [32, 2])
def test_components_match_brute_force(spark, odd_docs, monkeypatch, short):
    """With SHORT = 2 nearly every list takes the long way, in blocks of five."""
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8192 if short == 32 else 5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(odd_docs).collect())
    assert got == brute_components(docs_of(odd_docs))


def test_components_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in op10_ngram_jaccard_join(spark, SF).collect())
    assert got == brute_components(docs_of(docs))


def test_join_of_an_empty_table(spark, no_docs):
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_boundary_follows_the_counts():
    assert 0 < jaccard_join.boundary({3: 100, 12: 1}) < 12
    assert jaccard_join.boundary({}) == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40), min_size=1, max_size=300), st.sets(st.integers(0, 2**40), max_size=60))
def test_sketches_never_rule_out_a_link(base, other):
    import numpy as np

    from stepwise.llm.hashing import mix

    pack = lambda s: np.unique(mix(np.array(sorted(s), dtype=np.uint64)))
    a, b = pack(base), pack(base | other)
    if 7 * len(np.intersect1d(a, b)) >= 3 * (len(a) + len(b)):
        assert jaccard_join.may_link(len(a), jaccard_join.sketch(a), len(b), jaccard_join.sketch(b))
