import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import byte_bpe, decontaminate, license_scan, lm_score, pseudonyms, token_counts
from helixframe.llm.common import alnum_words, space_words
from helixframe.llm.pieces import BYTE_PENALTY, SPACE, default_path, piece_weights

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_words_equal_their_patterns(awkward):
    rng = random.Random(0)
    texts = [t or "" for t in awkward] + ["".join(chr(rng.choice([*range(1, 256), 0x2028, 0x3000, 0x1F600])) for _ in range(200)) for _ in range(50)]
    for t in texts:
        low = t.translate(UP)
        assert [w.decode() for w in alnum_words(t.encode())] == WORD.findall(low)
        assert [w.decode() for w in space_words(t.encode())] == re.findall(r"[^\x20\x09-\x0D]+", low)


def brute_contamination(text, items, width=10):
    w = WORD.findall((text or "").translate(UP))
    hit, met = set(), set()
    for item, t in items:
        x = WORD.findall((t or "").translate(UP))
        size = min(width, len(x))
        for i in range(len(x) - size + 1 if x else 0):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == x[i : i + size]:
                    hit |= set(range(p, p + size))
                    met.add(item)
    return len(w), len(hit), sorted(str(m) for m in met if m is not None)


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_contamination(spark, docs, awkward, block):
    rng = random.Random(2)
    items = [(1, "a b c d e f g h i j k l"), (2, "The Cat"), (3, ""), (4, None), (11, " ".join(rng.choice("abc") for _ in range(30))), (None, "ß é"), (2, "the cat"), (12, "x " * 12)]
    texts = awkward[:9] + [" ".join(rng.choice("abc") for _ in range(200)) for _ in range(20)] + ["z " + items[0][1].upper() + ". " + items[4][1]]
    d = docs(texts)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r.hit for r in decontaminate.contamination(d, it, block_bytes=block).collect()}
    for i, t in enumerate(texts):
        n, hit, met = brute_contamination(t, items)
        assert (got[i].n_words, got[i].n_hit, list(got[i]["items"])) == (n, hit, met), t
        assert got[i].contaminated == (hit > 0) and got[i].n_items == len(met)
    empty = decontaminate.contamination(d, it.limit(0), block_bytes=block).collect()
    assert not any(r.hit.contaminated for r in empty)
    clash = decontaminate.contamination(d.withColumnRenamed("normal", "hit").withColumnRenamed("rid", "spans"), it, block_bytes=block)
    assert clash.columns == ["doc_id", "text", "spans", "hit", "_hit"]
    assert {r.doc_id: r._hit for r in clash.collect()} == got


def test_index_is_compact():
    """A block's index takes at most a dozen times its text."""
    import pickle

    rng = random.Random(1)
    words = [f"w{rng.randrange(50000)}" for _ in range(200_000)]
    items = [(str(i), " ".join(words[i * 100 : i * 100 + 100]).encode()) for i in range(2000)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontaminate.WindowIndex(items, 10, lambda w: 0))) < 12 * size


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers as P
    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    return path, pattern, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_the_library(spark, docs, awkward, bpe):
    path, pattern, library = bpe
    rng = random.Random(4)
    texts = awkward + ["".join(rng.choice("abé ñ12\n\t'sxyz漢<|endoftext|>") for _ in range(rng.randint(0, 300))) for _ in range(100)] + ["ab" * 3000, "".join(map(chr, range(0x20, 0x3000)))]
    out = byte_bpe.decode(byte_bpe.encode(docs(texts), path, pattern), path, pattern)
    for r in out.select("*", byte_bpe.unpack("ids").alias("list")).collect():
        t = texts[r.doc_id] or ""
        want = library.encode_ordinary(t)
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == want and r.list == want and r.decoded == t.encode()
    for r in byte_bpe.digests(docs(texts), path, pattern).collect():
        t = texts[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert byte_bpe.digests(docs(texts).limit(0), path, pattern).count() == 0


def test_repeated_rows_and_clashing_names(docs, bpe):
    """Rows of equal id and text are rows of their own; columns of a table keep their names and values."""
    d = docs(["some text", "some text", None], [4, 4, None]).selectExpr("*", "'i' ids", "'d' decoded", "'t' tokens", "'f' found")
    path, pattern, _ = bpe
    out = byte_bpe.round_trip(d, path, pattern)
    assert out.columns[-2:] == ["_ids", "_decoded"]
    rows = sorted(out.collect(), key=lambda r: str(r.text))
    assert [(r.ids, r.decoded, bytes(r._decoded)) for r in rows] == [("i", "d", b"")] + [("i", "d", b"some text")] * 2
    assert byte_bpe.decode(byte_bpe.encode(d, path, pattern), path, pattern, "_ids").columns[-2:] == ["_ids", "_decoded"]
    counted = token_counts.token_counts(d)
    assert counted.columns[-1] == "_tokens" and sorted(r._tokens.n_pretokens for r in counted.collect()) == [0, 2, 2]
    assert token_counts.token_counts(d.limit(0)).count() == 0
    assert pseudonyms.pseudonymise(d, "k").columns[-1] == "_found"
    assert byte_bpe.digests(d, path, pattern).count() == 3


def test_segment_tree_and_step_merges_agree(bpe):
    ranks = byte_bpe.read_ranks(bpe[0])
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abcdethionsé ") for _ in range(rng.randint(1, 90))).encode() for _ in range(300)]
    assert byte_bpe.Merger(ranks)(pieces) == [struct.pack(f"<{len(m)}I", *m) for m in (byte_bpe.merge(p, ranks) for p in pieces)]


def test_token_counts(docs, awkward):
    w = piece_weights(default_path())
    byte = min(w.values()) - BYTE_PENALTY

    def brute(s):
        best = [(0.0, 0)]
        for j in range(1, len(s) + 1):
            o = [(best[i][0] + w[s[i:j]], best[i][1] - 1) for i in range(max(0, j - 40), j) if s[i:j] in w]
            if s[j - 1] not in w:
                n = len(s[j - 1].encode())
                o.append((best[j - 1][0] + n * byte, best[j - 1][1] - n))
            best.append(max(o))
        return -best[-1][1]

    texts = awkward + ["hello world unbelievable 漢字 \U0001f600 naïve", "a" * 300, "hello world"]
    for r in token_counts.token_counts(docs(texts)).collect():
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", texts[r.doc_id] or "") if x]
        counts = [brute(SPACE + x) for x in words]
        assert (r.tokens.n_pretokens, r.tokens.n_tokens, r.tokens.longest) == (len(words), sum(counts), max(counts, default=0))


def test_lattice_adds_all_segmentations():
    import numpy as np

    names, p = lm_score.lattice_pieces(default_path())
    index = {n: p[i] for i, n in enumerate(names) if i}
    lattice = lm_score.Lattice(names, np.stack([p, p]), np.array([0.3, 0.4]))

    def brute(w, stop):
        total = 0.0
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
            parts = [index.get(w[a:b], 0.0) for a, b in zip(at, at[1:])]
            total += math.prod(parts) * (1 - stop) ** (len(parts) - 1) * stop
        return math.log(total)

    for words in ([b"the", b"ing"], [b"hation", b"\xc3\xa9rant"[:6]], [b"x"]):
        got = lattice.log_probability(words)
        assert np.allclose(got[0], [brute(w, 0.3) for w in words]) and np.allclose(got[1], [brute(w, 0.4) for w in words])
    assert np.isfinite(lattice.log_probability([b"ab" * 5000])).all()


def test_lattice_has_the_longest_pieces():
    import numpy as np

    path = default_path()
    want = {raw for piece in piece_weights(path) if (raw := piece.replace(SPACE, "").encode()) and raw == raw.lower()}
    names, p = lm_score.lattice_pieces(path)
    assert want <= set(names) and max(map(len, want)) > 16
    lattice = lm_score.Lattice(names, p[None], np.array([0.3]))
    long = [w for w in want if len(w) > 16]
    for w in long:  # the arc over the whole word is among its arcs
        assert names.index(w) in lattice.arcs([w])[:, 0]
    # a forward sum over all pieces by their ends, word after word
    for w in (*long, b"x" + long[0] + b"yz"):
        sums = [1.0] + [0.0] * len(w)
        index = {n: p[i] * 0.7 for i, n in enumerate(names) if i}
        for j in range(1, len(w) + 1):
            sums[j] = sum(sums[i] * index.get(w[i:j], 0.0) for i in range(j))
        assert np.allclose(lattice.log_probability([w])[0, 0], math.log(sums[-1] * 0.3 / 0.7))


def test_long_words_walk_the_same_lattice():
    import numpy as np

    names, p = lm_score.lattice_pieces(default_path())
    lattice = lm_score.Lattice(names, np.stack([p, p[::-1].copy() + 1e-9]), np.array([0.3, 0.4]))
    rng = random.Random(1)
    words = ["".join(rng.choice("thionaerséñ") for _ in range(n)).encode() for n in (1, 2, 40, 700, 1500)]
    for w in words:
        for chunk in (1, 7, 64, 2048):
            if len(w) < 800 or chunk > 7:
                assert np.allclose(lattice.walk(w, chunk), lattice.log_probability([w])[:, 0])
    assert np.isfinite(lattice.log_probability([b"base64/" * 40000])).all()
    assert b"".join(lm_score.sections([b"ab", b"xyz" * 2000])[1:]) == b"xyz" * 2000


def test_score_equals_brute_force(spark):
    """Two classes, every word's segmentations by enumeration, the mixture by hand."""
    texts = ["the hat", "the then at", None, "le chat", "le hat le", "unseen the", "hatch"]
    kind = ["en", "en", "en", "fr", "fr", None, None]
    d = spark.createDataFrame(list(zip(range(7), texts, kind, [k is not None for k in kind])), "doc_id int, text string, lang string, learn boolean")
    got = {r.doc_id: r.score for r in lm_score.lm_scores(d, "learn", class_col="lang", rounds=0).collect()}
    names, p = lm_score.lattice_pieces(default_path())
    index = {n: p[i] for i, n in enumerate(names) if i}

    def marginal(w, stop=0.3):
        total = 0.0
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
            parts = [index.get(w[a:b], 0.0) for a, b in zip(at, at[1:])]
            total += math.prod(parts) * (1 - stop) ** (len(parts) - 1) * stop
        return total

    words = [space_words((t or "").encode()) for t in texts]
    c = {z: Counter(w for ws, k in zip(words, kind) if k == z for w in ws) for z in ("en", "fr")}
    both = c["en"] + c["fr"]
    once, twice = (sum(n == k for n in both.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    ends = {"en": 3, "fr": 2}
    for i, ws in enumerate(words):
        total = 0.0
        for z in ("en", "fr"):
            reserve, below = discount * len(c[z]) + 1, sum(c[z].values()) + ends[z] + 2
            q = (ends[z] + 1) / below
            for w in ws:
                share = lm_score.SHARED * both[w] / sum(both.values()) + (1 - lm_score.SHARED) * marginal(w)
                q *= (max(c[z][w] - discount, 0) + reserve * share) / below
            total += q * (ends[z] + 1) / (5 + 2)
        assert got[i] == pytest.approx(math.log10(total))


def test_lm_scores(spark, awkward):
    rng = random.Random(6)
    vocabulary = {"en": ["the", "hat", "on", "thering", "wh"], "fr": ["le", "éau", "oi", "réeux", "un"]}
    texts = [t for t in awkward if t is None or len(t) < 100] + [" ".join(rng.choice(vocabulary[k]) for _ in range(40)) for k in ("en", "fr") * 30] + ["entirely novelwords here", "thehat"]
    lang = [None] * (len(texts) - 62) + ["en", "fr"] * 30 + ["en", "en"]
    d = spark.createDataFrame([(i, t, a, zlib.crc32(str(i).encode()) % 7 != 2) for i, (t, a) in enumerate(zip(texts, lang))], "doc_id bigint, text string, lang string, learn boolean")
    words = [space_words((t or "").encode()) for t in texts]
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    c = Counter(w for ws, k in zip(words, learn) if k for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for head in (10**6, 3):  # all words broadcast, or most of them joined
        got = {r.doc_id: r for r in lm_score.lm_scores(d, "learn", class_col="lang", head=head).collect()}
        for i, ws in enumerate(words):
            assert got[i].train_tokens == n and got[i].n_tokens == len(ws) + 1
            assert got[i].n_known == sum(c[w] > 0 for w in [*ws, None])
            assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]))
            assert got[i].score < 0 and math.isfinite(got[i].score)
        if head == 3:
            assert [got[i].score for i in got] == pytest.approx([before[i].score for i in got])
        before = got
    # words that fit a class together are likelier than the same number of both
    few = spark.createDataFrame([(0, "the hat on the hat on"), (1, "le hat oi the un on")], "doc_id bigint, text string")
    both = lm_score.lm_scores(few.selectExpr("doc_id", "text", "'' as lang", "false as learn").unionByName(d), "learn", class_col="lang").where("doc_id < 2 and n_tokens = 7").collect()
    s = {r.doc_id: r.score for r in both}
    assert s[0] > s[1]
    assert lm_score.lm_scores(d.where("false"), "learn").count() == 0
    alone = lm_score.lm_scores(d.withColumn("learn", d.learn & False), "learn").collect()
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in alone)


def brute_licence(text):
    w = WORD.findall((text or "").translate(UP))
    at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), sorted({x for _, x in at})


def brute_matches(index, words):
    """Every template at every start."""
    places = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    out = []
    for t, (_, template, _) in enumerate(index.templates):
        out += index._matches(t, range(-len(template), len(words) + 1), words, places)
    return out


def test_prefix_words_miss_no_match():
    """Looking up the words that no match can do without finds what trying every start finds."""
    rng = random.Random(8)
    frequency = {w: rng.choice([0, 1, 5, 900]) for _, text, _ in license_scan.TEMPLATES for w in alnum_words(text.encode())}
    index = license_scan.LicenceIndex.build(license_scan.TEMPLATES, license_scan.PHRASES, frequency, 1000)
    met = 0
    for _ in range(60):
        text = []
        for _ in range(rng.randint(1, 3)):
            words = alnum_words(rng.choice(license_scan.TEMPLATES)[1].encode())
            words = words[rng.choice([0, 0, len(words) // 5]) :]
            text += [b"pad"] * rng.randint(0, 30) + [w if rng.random() > 0.1 else rng.choice([b"x", w, b"the"]) for w in words if rng.random() > 0.03]
        got = index.scan(b" ".join(text))[2]
        assert got == brute_matches(index, text)
        met += len(got)
    assert met > 60


def test_licences(docs, awkward):
    texts = awkward + ["Licensed under CC BY-NC 4.0. x Licensed under the Apache License, Version 2.0", "under-the MIT license!", "This work is licensed under the GNU General Public License, version 3.", "under a mit license, apache version 2", "cc by", "general public version license gnu 3 under", license_scan.TEMPLATES[0][1] + " and more"]
    got = {r.doc_id: r.licence for r in license_scan.license_scan(docs(texts)).collect()}
    for i, t in enumerate(texts):
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, list(g.base_labels)) == brute_licence(t), t
        assert set(g.base_labels) <= set(g.labels) and 0 <= g.score <= 1
    n = len(awkward)
    assert list(got[n + 2].labels) == ["gpl-3"] and list(got[n + 3].labels) == [] and list(got[n + 5].labels) == [] and "mit" in got[n + 6].labels
    assert license_scan.license_scan(docs(texts).limit(0)).count() == 0
    clash = license_scan.license_scan(docs([license_scan.TEMPLATES[0][1]] * 2, [3, 3]).withColumnRenamed("normal", "licence"))
    assert clash.columns[-1] == "_licence" and [list(r._licence.labels) for r in clash.collect()] == [["mit"]] * 2


def feistel(key, kind, size, a, b, m, n):
    f = lambda i, x: int(hashlib.sha256(f"{key}|{kind}|{size}|{i}|{x}".encode()).hexdigest()[:15], 16)
    for i in range(8):
        a, b = ((a + f(i, b)) % m, b) if i % 2 == 0 else (a, (b + f(i, a)) % n)
    return a, b


def digits(key, kind, d):
    h = len(d) // 2
    a, b = feistel(key, kind, len(d), int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h))
    return f"{a:0{h}d}{b:0{len(d) - h}d}"


def luhn(d):
    return sum(x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pseudonyms(docs, awkward):
    texts = awkward + ["card 4111111111111111, 4111 1111 1111 1111 and 4111111111111112", "1.2.3.4 9.9.9.300", "+1 (017) 555-7713!!", "2024-02-29 2023-02-29 02/29/2024 29.02.2024", "123-45-6789 666-45-6789", "a ab.1@mail7.example.com", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "no 12 numbers 3.5 here 2024"]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs(texts), "k").collect()}
    n = len(awkward)
    for i in range(n):
        assert got[i].text == texts[i] and got[i].found == []
    card = digits("k", "card", "411111111111111")
    card = next(card + x for x in "0123456789" if luhn(card + x))
    assert got[n].text == f"card {card}, {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} and 4111111111111112"
    a, b = feistel("k", "ip", 4, 258, 772, 65536, 65536)
    assert got[n + 1].text == f"{a // 256}.{a % 256}.{b // 256}.{b % 256} 9.9.9.300"
    p = digits("k", "phone", "0175557713")
    assert got[n + 2].text == f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}!!"
    new = got[n + 3].text.split()
    assert new[1] == "2023-02-29" and got[n + 3].found == ["date"] * 3
    y, m, d = new[0].split("-")
    assert new[2] == f"{m}/{d}/{y}" and new[3] == f"{d}.{m}.{y}" and new[0] != "2024-02-29"
    assert got[n + 4].text.split()[1] == "666-45-6789" and re.fullmatch(r"\d{3}-\d{2}-\d{4}", got[n + 4].text.split()[0])
    assert got[n + 5].text.endswith("@mail7.example.com") and "ab.1" not in got[n + 5].text
    assert "04dbebab" not in got[n + 6].text and re.search(r'"[0-9a-f]{40}"', got[n + 6].text)
    assert got[n + 7].text == texts[n + 7]


def test_pseudonyms_without_digits(docs):
    secret = "abcdefabcdefabcdefabcdefabcdefabcdefabcd"
    texts = ["write to jane.doe@example.com", "write to jane.doe@example.com 7", f"token {secret} end", f"token {secret} end 7", "mail @ noon", "beef cafe"]
    got = sorted(pseudonyms.pseudonymise(docs(texts), "k").collect(), key=lambda r: r.doc_id)
    assert [r.found for r in got] == [["email"], ["email"], ["secret"], ["secret"], [], []]
    assert got[0].text + " 7" == got[1].text and got[2].text + " 7" == got[3].text
    assert "jane" not in got[0].text and got[0].text.endswith("@example.com") and secret not in got[2].text
    assert [r.text for r in got[4:]] == texts[4:]


def test_pseudonyms_of_very_long_matches(docs):
    """Nothing in the shapes recurses with the length of a text."""
    texts = ["x1@" + "a." * 5000 + "com", "x1@" + "ab." * 400000 + "com", "x1@" + "a" * 10**6 + ".com", "1" * 10**6, "f" * 10**6 + "1", "1.2." * 250000, "(555) " * 100000, "9" * 16 + " " + "x" * 10**6]
    got = sorted(pseudonyms.pseudonymise(docs(texts), "k").collect(), key=lambda r: r.doc_id)
    assert [len(r.found) for r in got[2:]] == [1, 0, 0, 0, 0, 0] and got[3].text == texts[3]
    assert pseudonyms.pseudonymise(docs(texts[:0]), "k").count() == 0
    same = sorted(pseudonyms.pseudonymise(docs(["1.2.3.4"] * 3, [5, 5, None]), "k").collect(), key=lambda r: str(r.doc_id))
    assert len({r.text for r in same}) == 1 and len(same) == 3


def test_pseudonyms_of_domains_of_any_length(docs):
    texts = [f"to jane.doe@{'x.' * n}com, she" for n in (126, 127, 128, 131, 500_000)] + [f"to jane.doe@{'xy.' * 200}com"]
    got = sorted(pseudonyms.pseudonymise(docs(texts), "k").collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts, strict=True):
        assert list(r.found) == ["email"] and "jane" not in r.text and len(r.text) == len(t) and r.text[11:] == t[11:]


def test_pseudonyms_are_permutations(spark):
    from pyspark.sql import functions as F

    d = spark.range(0, 146097, 7).select(F.date_format(F.expr("date_add(date'1800-01-01', cast(id as int))"), "yyyy-MM-dd").alias("text"))
    assert pseudonyms.pseudonymise(d, "k").where("size(found) = 1").select("text").distinct().count() == d.count()
    d = spark.range(20000).select(F.concat(F.lit("1.2."), (F.col("id") / 256).cast("int") % 256, F.lit("."), F.col("id") % 256).alias("text"))
    assert pseudonyms.pseudonymise(d, "k").select("text").distinct().count() == 20000
