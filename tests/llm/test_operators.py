"""Every operator against a plain brute-force version, and on rows with nulls, repeats, long texts and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import arrow_files, chosen_path, decontaminate, divergence, hilbert, packing, paragraphs, pitman_yor, suffix_dedup, surrogates
from alertloom.llm.encoder import tokenizer_path
from alertloom.llm.induced import suffix_array
from alertloom.llm.store import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, shard int, b int, rid long, key string, node long, size long, id long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    shared = " ".join(prose(10) for _ in range(9))
    base = [prose(rng.randint(5, 120)) for _ in range(40)]
    out = dict(enumerate(base))
    out[40], out[41] = out[3], out[3]
    words = out[5].split() * 3
    out[42], out[43] = " ".join(words), " ".join(words[:-2] + ["zz"])
    out[44], out[45] = f"{prose(20)} {shared} {prose(20)}", f"{prose(30)} {shared} {prose(9)}"
    out[46], out[47], out[48] = None, "", " \n\t "
    out[49] = prose(9000) + "\n" + prose(30) + "\n" + shared
    out[50] = "Line one of five words.\n" * 6 + "x\x0b\x0cy  z   é́ 'tis we'll 42."
    out[51] = "MIOSRA " * 300
    out[52] = "Write to Ann.B@Mail.example.org or ann.b@mail.example.org, +1 (988) 555-2485, 4111-1111-1111-1111, 10.1.2.3, Mrs. Smith."
    return out


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    row = lambda i, t: (i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}", len(t or ""), 1, 2, 3, 4, "k", 5, 6, 7)
    rows = [row(i, t) for i, t in TEXTS.items()] + [row(3, TEXTS[3]), row(None, "null id " + TEXTS[7])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return df.collect()


def everything():
    return list(TEXTS.items()) + [(3, TEXTS[3]), (None, "null id " + TEXTS[7])]


def encoded(name, text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(150):
        text = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 90))] + [0]
        order, prefixes = suffix_array(np.array(text), 50, rng.choice([64, 1 << 20]))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert list(order) == want
        for k in range(1, len(text)):
            a, b, n = text[want[k - 1] :], text[want[k] :], 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert min(n, 50) == min(int(prefixes[k]), 50)


def test_only_ties_are_sorted_again(monkeypatch):
    from alertloom.llm import induced

    rng = np.random.default_rng(2)
    text = np.concatenate((rng.permutation(5000) + 2, [7, 8, 9, 10, 7, 8, 9, 11, 7, 8, 9], [1, 0]))
    want = sorted(range(len(text)), key=lambda k: text[k:].tolist())
    start, held, argsort = np.argsort(text, kind="stable"), [], np.argsort
    monkeypatch.setattr(induced.np, "argsort", lambda x, **how: held.append(len(x)) or argsort(x, **how))
    assert induced._doubled(text, start).tolist() == want
    assert sum(held) < 60


def test_common_prefixes_of_bytes():
    from alertloom.llm import induced

    rng = random.Random(6)
    for symbols, n in (("ab", 400), ("a", 70), ("abcdefgh", 300)):
        text = np.array([ord(rng.choice(symbols)) for _ in range(n)] + [250, 255, 255, 0])
        order = np.array(sorted(range(len(text)), key=lambda k: text[k:].tolist()))
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), len(text) - max(a, b))
        want = [0] + [min(common(a, b), 50) for a, b in itertools.pairwise(order.tolist())]
        assert induced._common(text, order, 50).tolist() == want == induced._common_bytes(text.astype(np.uint8), order, 50).tolist()


def test_suffix_dedup(docs, nothing):
    data = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in everything()]
    first = {}
    for i, t in data:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            first[w] = min(first.get(w, i), i)
    want = []
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        left = bytes(c for c, x in zip(t, gone) if not x)
        want.append((i, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    got = [(-(1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(suffix_dedup.dedup(docs))]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 500
    assert rows_of(suffix_dedup.dedup(nothing)) == []


def test_surrogates(docs, nothing):
    out = surrogates.replace(docs)
    assert out.columns == [*docs.columns, "__mentions"] and out.count() == len(everything())
    row = out.where("doc_id = 52").first()
    old, new = TEXTS[52], row.text
    assert row["__mentions"] == ["email", "email", "phone", "card", "ip", "name"] and row.n_chars == len(new)
    for private in ("Ann", "ann.b", "555-2485", "4111", "10.1.2.3", "Smith"):
        assert private in old and private not in new
    mails = re.findall(r"\S+@\S+\.org", new)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and mails[0] != mails[1]
    digits = [int(c) for c in re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", new)[0].replace("-", "")][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and " 10." in new and "Mrs. " in new
    same = {r.doc_id: r.text for r in rows_of(out) if not r["__mentions"] and r.doc_id is not None}
    assert all(TEXTS[i] == t for i, t in same.items())
    assert rows_of(surrogates.replace(nothing)) == []


def test_surrogates_of_a_full_network(spark):
    """More addresses of a private network than it has to spare: all get distinct, private ones that are nobody's own."""
    many = spark.range(40000).selectExpr("'ip' AS kind", "concat('192.168.', 1 + id div 200, '.', 1 + id % 200) AS value")
    got = rows_of(surrogates.resolved(many, "k"))
    new = {r.surrogate for r in got}
    assert len(new) == len(got) == 40000 and not new & {r.value for r in got}
    assert {s.split(".")[0] for s in new} == {"10", "192"}


def test_surrogates_stay_distinct(spark):
    many = spark.range(3000).selectExpr("'ssn' AS kind", "lpad(cast(id AS string), 3, '0') AS value").distinct()
    found = surrogates.resolved(many.where("length(value) = 3").limit(200), "k")
    got = rows_of(found)
    assert len({r.surrogate for r in got}) == len(got) == 200
    assert not {r.surrogate for r in got} & {r.value for r in got} and max(r.attempt for r in got) > 0


def test_divergence(docs, nothing):
    features = docs.select("doc_id", "text", divergence.features(F.col("text")).alias("f"))
    for r in rows_of(features):
        text = r.text or ""
        own, seen, repeated = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                repeated += line in seen
                seen.add(line)
        windows = collections.defaultdict(list)
        for k in range(len(own) - 4):
            windows[tuple(own[k : k + 5])].append(k)
        inside = {k + j for v in windows.values() if len(v) > 1 for k in v for j in range(5)}
        assert (r.f.n_words, r.f.word_chars, r.f.n_dup_lines, r.f.n_repeat_words) == (len(own), sum(map(len, own)), repeated, len(inside))
        assert r.f.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and sum(r.f.chars) == len(text)
        assert list(r.f.common) == [sum(w in (x, x.capitalize(), x.upper()) for w in own) for x in divergence.LEXICON]
    kept = divergence.keep(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(everything())
    assert rows_of(divergence.keep(nothing)) == []


def test_verdict(spark):
    """Against a plain version of the rules; prose stays, words in pipes and words with signs go, of 60 words too."""
    rng = random.Random(4)
    common = {"en": divergence.COMMON["en"], "de": divergence.COMMON["de"]}
    rare = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    rows, kind = [], {}
    for i in range(600):
        lang, n = rng.choice(["en", "de"]), rng.choice([12, 60, 90, 150, 600])
        prose = [rng.choice(common[lang]) if rng.random() < 0.35 else rng.choice(rare) for _ in range(n)]
        kind[i] = "prose" if i % 10 else "pipes" if i % 20 else "signs"
        text = " ".join(prose) + "."
        if kind[i] == "pipes":
            text = " | ".join(rng.choice(rare) for _ in range(n // 2))
        elif kind[i] == "signs":
            text = " ".join(rng.choice(rare) + rng.choice(["&&&", "%%%", "$$$"]) for _ in range(n))
        rows.append((i, lang if i % 50 != 1 else "xx", text))
    rows += [(600, "en", None), (601, "en", " ".join(["the same five words again"] * 30))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("f", divergence.features(F.col("text")))
    held = {r.doc_id: r for r in rows_of(df)}

    def distance(p, q):
        part = lambda x, y: sum(a * math.log2(2 * a / (a + b)) for a, b in zip(x, y) if a)
        return math.sqrt(max((part(p, q) + part(q, p)) / 2, 0))

    shares = lambda counts, total: [c / total for c in counts]
    words = lambda f: [*f.common, f.n_words - sum(f.common)]
    known = {}
    for lang in ("en", "de"):
        own = [r.f for r in held.values() if r.lang == lang]
        sums = [[sum(c) for c in zip(*part)] for part in ([f.chars for f in own], [words(f) for f in own])]
        known[lang] = [shares(c, sum(c)) for c in sums]
    judged = divergence.judge(df, "f", "lang", divergence.references(df, "lang", "f"), "v")
    got = {r.doc_id: r.v for r in rows_of(judged)}
    for i, r in held.items():
        f, near = r.f, [known[r.lang]] if r.lang in known else list(known.values())
        base = f.n_words < 10 or 100 * f.n_repeat_words > 20 * f.n_words
        c = min(distance(shares(f.chars, sum(f.chars)), k[0]) for k in near) if f.word_chars >= 200 else None
        w = min(distance(shares(words(f), f.n_words), k[1]) for k in near) if f.n_words >= 10 else None
        far = (c or 0) > 0.33 or (f.n_words >= 100 and w > 0.40) or ((c or 0) > 0.11 and w > 0.10 + 1.2 / math.sqrt(f.n_words))
        v = got[i]
        assert (v.base_failed, v.kept) == (base, not base and not far), i
        assert v.chars_distance == (c if c is None else pytest.approx(c, abs=2e-6)) and v.words_distance == (w if w is None else pytest.approx(w, abs=2e-6))
    long = [i for i in kind if held[i].f.word_chars >= 200]
    wrong = [(held[i].f.n_words, got[i]) for i in long if kind[i] == "prose" and not got[i].kept]
    assert len(wrong) <= 4 and all(n < 100 for n, _ in wrong), wrong
    missed = [(kind[i], held[i].f.n_words, got[i]) for i in long if kind[i] != "prose" and held[i].f.n_words >= 60 and got[i].kept]
    assert not missed, missed
    assert not got[600].kept and not got[601].kept


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(divergence.distance(F.col("p"), F.col("q"))).first()
    m = [(a + b) / 2 for a, b in zip(p, q)]
    part = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a)
    assert row[0] == pytest.approx(math.sqrt((part(p) + part(q)) / 2))


@pytest.mark.parametrize("name, style", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_added_tokens(name, style):
    """As the plain library encodes them, in texts with each added token."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from alertloom.llm.encoder import Encoder

    plain = Tokenizer.from_file(tokenizer_path(name))
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in added
    some = ["end {} go", "{}", "{}{} x{}y", "A b.{}. C,\n{}\tz", " {} ", "{} " + TEXTS[5]]
    texts = [s.replace("{}", form) for s in some for t in added for form in (t, t.upper(), t[:-1])] + [TEXTS[9], "", None, "Plain text."]
    ids, bounds = Encoder(tokenizer_path(name), style).batch(pa.array(texts))
    for k, text in enumerate(texts):
        assert list(ids[bounds[k] : bounds[k + 1]]) == plain.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("name, style", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_encoder_keeps_frequent_words_in_little_memory(monkeypatch, name, style):
    """Words met often outlive those met once, the tokenizer gets few characters a call, ids are as without any of this."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from alertloom.llm import encoder

    monkeypatch.setattr(encoder, "KEPT_WORDS", 400)
    monkeypatch.setattr(encoder, "AT_ONCE", 2000)
    code, plain = encoder.Encoder(tokenizer_path(name), style), Tokenizer.from_file(tokenizer_path(name))
    calls, rng = [], random.Random(4)

    class Counted:
        def encode_batch_fast(self, texts, **how):
            calls.append([len(t) for t in texts])
            return plain.encode_batch_fast(texts, **how)

    code.tokenizer = Counted()
    common = ["common" + chr(97 + k) for k in range(20)]
    for turn in range(12):
        rare = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(150)]
        texts = [" ".join(rng.sample(common + rare, 170)) + (".  Two\tblanks\n x" if k > 7 else ".") for k in range(10)]
        ids, bounds = code.batch(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert set(common) <= set(code.known) or turn == 0
    assert len(code.known) < 400 + 200
    assert max(sum(c) - c[-1] for c in calls) < 2000


def test_arrow_files(spark, docs, nothing):
    manifest = arrow_files.write(docs, shared_folder(spark), tokenizer_path("word_bpe_49k.json"), shards=4)
    got = sorted(rows_of(arrow_files.read(manifest)), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _ in everything()], key=lambda i: -1 if i is None else i)
    by_id, at = {i: t for i, t in everything()}, 0
    for r in got:
        ids = encoded("word_bpe_49k.json", by_id[r.doc_id]) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (at, len(ids), crc(ids), ids)
        at += len(ids)
    folder, copies = shared_folder(spark), spark.createDataFrame([(i, "some words of this text " * 400) for i in range(40)], "doc_id long, text string")
    one = arrow_files.write(copies, folder, tokenizer_path("word_bpe_49k.json"), shards=1, length=128).first()
    small = arrow_files.Sequences(one.sequences)
    counts = [small.reader.get_batch(k).num_rows for k in range(small.reader.num_record_batches)]
    whole = np.concatenate(list(small.stream()))
    assert len(counts) > 2 and set(counts[:-1]) == {arrow_files.BATCH_ROWS}
    for r in range(sum(counts)):
        ids, mask = small.row(r)
        assert ids[: mask.sum()].tolist() == whole[r * small.length : (r + 1) * small.length].tolist()
    sequences = arrow_files.Sequences(manifest.first().sequences)
    ids, mask = sequences.batch(0)
    assert ids.shape[1] == mask.shape[1] == arrow_files.LENGTH and ids.base is not None
    assert rows_of(arrow_files.read(arrow_files.write(nothing, shared_folder(spark), tokenizer_path("word_bpe_49k.json")))) == []


def test_decontamination(spark, docs, nothing):
    items = [(1, TEXTS[44][150:420]), (2, "Zz! zz"), (10, TEXTS[9]), (3, None), (4, "?!"), (None, TEXTS[8]), (2, "Zz! zz")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    patterns = collections.defaultdict(set)
    for item, text in items:
        own = CLEAN.findall((text or "").translate(LOW))
        if own and item is not None:
            for k in range(max(1, len(own) - 12)):
                patterns[tuple(own[k : k + 13])].add(item)
    for block_bytes in (decontaminate.BLOCK_BYTES, 200):
        got = rows_of(decontaminate.contamination(docs, benchmark, block_bytes))
        assert len(got) == len(everything())
        for r in got:
            text = TEXTS[r.doc_id] if r.doc_id is not None else everything()[-1][1]
            own, hit, found = CLEAN.findall((text or "").translate(LOW)), set(), set()
            for pattern, owners in patterns.items():
                for k in range(len(own) - len(pattern) + 1):
                    if tuple(own[k : k + len(pattern)]) == pattern:
                        hit.update(range(k, k + len(pattern)))
                        found |= owners
            sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(own), len(hit), len(found), sha)
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(own))
            assert sum(len(CLEAN.findall(text[s.begin : s.end].translate(LOW))) for s in r.spans) == len(hit)
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in got)
    assert rows_of(decontaminate.contamination(nothing, benchmark)) == []
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("n_hit > 0 OR contaminated").count() == 0


def test_packing(docs, nothing):
    got = rows_of(packing.pack(docs, tokenizer_path("byte_bpe_50k.json")))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in everything():
        ids, times = encoded("byte_bpe_50k.json", text) + [1], sum(j == i for j, _ in everything())
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == times * len(ids) and {r.doc_tokens for r in pieces} == {len(ids)}
        assert all(crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = list(itertools.accumulate(r.length for r in pieces))
        assert [r.offset for r in pieces] == [0, *ends[:-1]] and ends[-1] <= 2048
        assert ends[-1] & (ends[-1] - 1) == 0 or ends[-1] > 2048 - 64
    assert rows_of(packing.pack(nothing, tokenizer_path("byte_bpe_50k.json"))) == []


def shingled(text, size):
    own = WORD.findall((text or "").translate(LOW))
    return {tuple(own[k : k + size]) for k in range(max(1, len(own) - size + 1))} if own else set()


def test_near_duplicates(docs, nothing):
    sets = [(-1 if i is None else i, shingled(t, 4)) for i, t in everything()]
    least = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for (a, x), (b, y) in itertools.combinations(sets, 2):
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    want = sorted((i, len(s), least[i], least[i] == i) for i, s in sets)
    back = lambda i: -1 if i is None else i
    got = sorted((back(r.doc_id), r.n_shingles, back(r.component_id), r.kept) for r in rows_of(chosen_path.near_duplicates(docs)))
    assert got == want and sum(not w[3] for w in want) >= 3
    assert rows_of(chosen_path.near_duplicates(nothing)) == []


def test_large_nodes(spark, monkeypatch):
    """Blocks with hubs, branches and stray cells find what leaves find."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(90):
        own = base[:60] + [rng.choice(words) for _ in range(60)] if i % 3 == 0 else [w if rng.random() > 0.012 else f"x{i}" for w in base]
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, rows_of(chosen_path.near_duplicates(df))))
    monkeypatch.setattr(chosen_path, "LEAF", 8)
    monkeypatch.setattr(chosen_path, "CELL", 16)
    assert sorted(map(tuple, rows_of(chosen_path.near_duplicates(df)))) == want


def test_nodes_of_few_cells_meet_at_once(spark, monkeypatch):
    """A node that is little larger than a cell isn't branched: its strays meet all of it, and each class's rows stay few."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(base[:90] + [rng.choice(words) for _ in range(30)])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, rows_of(chosen_path.near_duplicates(df))))
    confirmed, compared, branched = chosen_path.confirmed, [], []

    def counted(groups, *more):
        compared.append(groups.count())
        return confirmed(groups, *more)

    monkeypatch.setattr(chosen_path, "confirmed", counted)
    monkeypatch.setattr(chosen_path, "branched", lambda rows, classes: branched.append(rows.count()) or rows)
    monkeypatch.setattr(chosen_path, "LEAF", 8)
    monkeypatch.setattr(chosen_path, "CELL", 128)
    assert sorted(map(tuple, rows_of(chosen_path.near_duplicates(df)))) == want
    assert not any(branched) and len(compared) == 3


def test_pitman_yor(docs, nothing):
    own = [(i, WORD.findall((t or "").translate(LOW)) + ["\0"]) for i, t in everything()]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, ws in own if not out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = rows_of(pitman_yor.scores(docs))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    want = sorted(((i, out(i), len(ws), sum(w in counts for w in ws), n) for i, ws in own), key=key)
    assert sorted((tuple(r)[:5] for r in got), key=key) == want
    base = {i: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) for i, ws in own}
    assert all(r.base_score == pytest.approx(base[r.doc_id]) and r.score < 0 for r in got)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert rows_of(pitman_yor.scores(nothing)) == []


def test_predictive_sums_to_one():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    words = np.sort(rng.integers(0, 1 << 60, 30, dtype=np.uint64))
    every = pitman_yor.CLASSES
    table = pa.table({
        "b": [0], "words": [words.tobytes()], "pairs": [np.full(30, every, np.uint8).tobytes()],
        "classes": [np.tile(np.arange(every, dtype=np.uint8), 30).tobytes()],
        "counts": [np.concatenate((rng.integers(0, 9, 29 * every), np.zeros(every))).astype(np.int32).tobytes()],
    })
    model = pitman_yor._Bucket(table)
    history = [model.totals()]
    for sweep in range(3):
        model.sweep(history[-1], (0, sweep))
        history.append(model.totals())
        total = np.bincount(model.kind, model.predictive(history[-1])[2], every)  # one word is unseen
        assert np.allclose(total, 1)


def test_pitman_yor_contexts_are_words(spark):
    """Contexts that end alike tell what follows them; probabilities in each context, with the unseen word, sum to one."""
    import pyarrow as pa

    lines = [(i, " ".join(f"{w}ing {n}" for _ in range(20) for w, n in random.Random(i).sample([("sail", "boat"), ("read", "book"), ("play", "ball")], 3))) for i in range(60)]
    train = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 != 2]
    boat, book = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [*zip(train, (t for _, t in lines)), (boat, "sailing boat " * 30), (book, "sailing book " * 30)]
    got = {r.doc_id: r.score for r in pitman_yor.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[boat] > got[book] + 5  # the last two bytes of the words before are the same

    table = pa.table({"doc_id": pa.array(train[:20]), "text": pa.array([t for _, t in lines[:20]])})
    words, _, _, _, which, counts, _ = pitman_yor._pairs(table)
    every = np.append(words, np.uint64(1))  # and one unseen word
    every.sort()
    n = len(every)
    seen = np.zeros((n, n), np.int32)
    hashes = pitman_yor.tokens(table["text"].combine_chunks())[0]
    np.add.at(seen, (np.searchsorted(every, hashes), np.searchsorted(every, np.insert(hashes[:-1], 0, np.uint64(pitman_yor._END)))), 1)
    assert seen.sum() == counts.sum()
    asked = pa.table({
        "b": [0], "words": [every.tobytes()], "pairs": [pitman_yor._packed(np.full(n, n), np.int32)], "contexts": [every.tobytes()],
        "classes": [(np.arange(n) % pitman_yor.CLASSES).astype(np.uint8).tobytes()],
        "places": [pitman_yor._steps(np.tile(np.arange(n), n))], "counts": [pitman_yor._packed(seen.ravel(), np.int32)],
    })
    model = pitman_yor._Contexts(asked)
    for sweep in range(3):
        model.context_tables, model.context_count = model.own()
        totals = model.totals()
        assert np.allclose(np.bincount(model.context, model.leaves(totals), n), 1)
        model.sweep(totals, (0, sweep))


def test_pitman_yor_messages_are_small(spark):
    """Hashes travel by their differences and carry the class of the word; nothing of them is lost."""
    text = " ".join(f"w{random.Random(k).randrange(5000)}" for k in range(40_000))
    block = spark.createDataFrame([(0, 1, text)], "b int, doc_id long, text string")
    asked = pitman_yor._asked(block, 4).toArrow()
    whole = pitman_yor._opened(asked)
    words, sizes, contexts, classes, _, _, _ = pitman_yor._pairs(block.toArrow())
    held = pitman_yor._arrays(whole, "words", np.uint64)
    assert sorted(np.concatenate(held).tolist()) == words.tolist()
    pairs = {(w, c, k) for w, c, k in zip(np.repeat(words, sizes).tolist(), contexts.tolist(), classes.tolist())}
    got = set()
    for own, n, names, kinds, places in zip(*(whole[c].to_pylist() for c in ("words", "pairs", "contexts", "classes", "places"))):
        at = pitman_yor._places(places)
        own = np.repeat(np.frombuffer(own, np.uint64), pitman_yor._unpacked(n, np.int32))
        got |= set(zip(own.tolist(), np.frombuffer(names, np.uint64)[at].tolist(), np.frombuffer(kinds, np.uint8)[at].tolist()))
    assert got == pairs
    raw = sum(len(x) for c in ("words", "contexts", "classes") for x in whole[c].to_pylist())
    assert sum(len(x) for c in ("words", "contexts") for x in asked[c].to_pylist()) < 0.85 * raw


def test_written_tables_leave_no_shuffle_files(spark):
    from alertloom.llm import store

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(store.CLEANUP, None)
    table = store.saved(spark.range(1000).repartition(7, "id"))
    name = pitman_yor._bucketed(spark.range(1000), 5, "id")
    for _ in range(100):  # they are deleted in the background
        if not files() - before:
            break
        time.sleep(0.1)
    else:
        raise AssertionError("shuffle files are still there")
    assert table.count() == 1000 and spark.table(name).count() == 1000
    assert spark.conf.get(store.CLEANUP, None) == setting


def test_hilbert(spark, docs, nothing):
    grid = spark.range(64 * 64).select((F.col("id") / 64).cast("long").alias("x"), (F.col("id") % 64).alias("y"))
    walk = grid.withColumn("h", hilbert.curve_index([F.col("x"), F.col("y")], 6)).orderBy("h").collect()
    assert [r.h for r in walk] == list(range(64 * 64))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(walk, walk[1:]))
    cells = lambda: [hilbert.quantised_log(F.col("n_chars"), 6), hilbert.quantised_name(F.col("lang"), 6)]
    got = rows_of(hilbert.shard(docs, cells()))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(everything()) and set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    sums = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in everything())
    assert sorted((r.size, r.text_crc32) for r in got) == sums
    assert rows_of(hilbert.shard(nothing, cells())) == []


def kept_by_brute_force(rows):
    """(doc_id, n_bytes, n_removed) of rows (doc_id, text), by clusters of all pairs of paragraphs and exact runs of units."""
    texts = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows}, key=lambda d: (d[0], d[1]))
    order = {d: (d[0], hash64(d[1])) for d in texts}
    texts.sort(key=order.get)
    units = {d: paragraphs.cuts(d[1].encode()) for d in texts}
    large = [(d, a, b, sh) for d in texts for a, b in whole_paragraphs(d[1].encode()) if (sh := frozenset(shingled(d[1].encode()[a:b].decode(), 5))) is not None and word_count(d[1].encode()[a:b]) >= 10]
    root = list(range(len(large)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, y in itertools.combinations(range(len(large)), 2):
        p, q = large[x][3], large[y][3]
        if 100 * len(p & q) >= 80 * len(p | q):
            i, j = sorted((find(x), find(y)))
            root[j] = i
    gone = {d: [] for d in texts}
    for k, (d, a, b, _) in enumerate(large):
        if find(k) != k:
            gone[d].append((a, b))
    first, runs = {}, []
    for d in texts:
        n = [word_count(d[1].encode()[a:b]) for a, b in units[d]]
        for j in range(len(n)):
            onward = next((e for e in range(j, len(n)) if sum(n[j : e + 1]) >= 10), None)
            back = next((b for b in range(j, -1, -1) if sum(n[b : j + 1]) >= 10), None)
            for a, b in {(j, onward), (back, j)}:
                if a is not None and b is not None:
                    begin, end = units[d][a][0], units[d][b][1]
                    words = tuple(WORD.findall(d[1].encode()[begin:end].decode().translate(LOW)))
                    runs.append((words, d, begin, end))
                    if not any(begin < y and x < end for x, y in gone[d]):
                        first[words] = min(first.get(words, (d, begin)), (d, begin), key=lambda f: (order[f[0]], f[1]))
    for words, d, begin, end in runs:
        f = first.get(words)
        if f and (order[f[0]], f[1]) < (order[d], begin):
            gone[d].append((begin, end))
    out = []
    for i, t in rows:
        d = (-(1 << 63) if i is None else i, t or "")
        lost = sum(b - a for a, b in units[d] if any(x <= a and b <= y for x, y in gone[d]))
        out.append((i, len(d[1].encode()), lost))
    return out


def hash64(text):
    import xxhash

    # Spark's hash of a string with seed 42
    return xxhash.xxh64_intdigest(text.encode(), 42)


def word_count(data):
    return len(WORD.findall(data.decode()))


def whole_paragraphs(data):
    """The paragraphs of a text: units up to the paragraph ends that the operator sets."""
    texts = [data]
    hashes, bounds = paragraphs._words(texts)
    units, large, firsts, at = paragraphs._units(texts, hashes, bounds)
    ends = paragraphs._ends(large, np.array([len(data)]), np.zeros(len(large), np.int64), at) if len(large) else []
    return list(zip((int(at[k]) for k in large), map(int, ends)))


def test_paragraphs(docs, nothing):
    """All rows, those with repeated and missing ids too."""
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in rows_of(paragraphs.removals(docs))), key=str)
    want = sorted(kept_by_brute_force(everything()), key=str)
    assert got == want and sum(w[2] for w in want) > 1000
    for r in rows_of(paragraphs.removals(docs)):
        assert r.n_removed == sum(s.end - s.begin for s in r.spans) and r.n_spans == len(r.spans)
    assert rows_of(paragraphs.removals(nothing)) == []


def test_unique_text_of_repeated_ids_stays(spark):
    rng = random.Random(31)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n)) + "."
    shared = prose(40)
    for same in (7, None):
        rows = [(1, shared + "\n" + prose(30)), (same, prose(80)), (same, shared + "\n" + prose(30)), (same, shared + "\n" + prose(30))]
        rows.append(rows[1])
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in rows_of(paragraphs.removals(df))), key=str)
        assert got == sorted(kept_by_brute_force(rows), key=str)
        assert all(lost == 0 for i, size, lost in got if size == len(rows[1][1]))
        assert sum(lost for _, _, lost in got) >= 2 * len(shared)


def passages(punctuated):
    """Twice as many texts as passages of 51 to 120 words; text k + 60 holds passage k once more, at another word."""
    rng, out, held = random.Random(7 + punctuated), {}, {}
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) + ("." if punctuated and rng.random() < 0.08 else "")
    for k in range(60):
        passage = [word() for _ in range(rng.randint(51, 120))]
        for i in (k, k + 60):
            before, behind = ([word() for _ in range(rng.randint(40, 200))] for _ in range(2))
            out[i], held[i] = " ".join(before + passage + behind), (len(" ".join(before)) + 1, len(" ".join(passage)))
    return out, held


@pytest.mark.parametrize("punctuated", [False, True])
def test_passages_in_running_text(spark, punctuated):
    texts, held = passages(punctuated)
    got = {r.doc_id: r for r in rows_of(paragraphs.removals(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))}
    assert all(got[i].n_removed == 0 for i in range(60))
    assert all(got[i].n_removed > 0 for i in range(60, 120))
    assert sum(got[i].n_removed for i in range(60, 120)) > 0.75 * sum(held[i][1] for i in range(60, 120))
    for i in range(60, 120):
        begin, size = held[i]
        # a paragraph that is nearly the passage may go with a few words beside it
        assert sum(min(s.end, begin + size + 1) - max(s.begin, begin) for s in got[i].spans) > 0.8 * got[i].n_removed


def test_repeated_spans(spark):
    """Against all runs of units; paragraphs repeat exactly or not at all."""
    texts = passages(False)[0] | {200 + i: t for i, t in passages(True)[0].items()}
    texts |= {400: texts[3] + "\n" + texts[9], 401: texts[63][: len(texts[63]) // 2], 402: " ".join(["aa bb cc"] * 40), 403: "\n \t", 404: texts[7].upper()}
    first, runs = {}, []
    for i, text in sorted(texts.items()):
        own = paragraphs.cuts(text.encode())
        words = [WORD.findall(text.encode()[a:b].decode().translate(LOW)) for a, b in own]
        n = [len(w) for w in words]
        for j in range(len(own)):
            onward = next((e for e in range(j, len(own)) if sum(n[j : e + 1]) >= 10), None)
            back = next((b for b in range(j, -1, -1) if sum(n[b : j + 1]) >= 10), None)
            for a, b in {(j, onward), (back, j)}:
                if a is not None and b is not None:
                    key = tuple(w for k in range(a, b + 1) for w in words[k])
                    runs.append((key, i, own[a : b + 1]))
                    first[key] = min(first.get(key, (i, own[a][0])), (i, own[a][0]))
    want = {(i, *u) for key, i, units in runs if first[key] != (i, units[0][0]) for u in units}
    removed = rows_of(paragraphs.removals(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    got = {(r.doc_id, s.begin, s.end) for r in removed for s in r.spans}
    assert want <= got and len(want) > 300
    by_paragraph = got - want
    assert len(by_paragraph) < len(want) // 20


def test_paragraphs_keep_what_may_repeat(spark, monkeypatch):
    """Only spans and paragraphs with their like elsewhere are written; however many buckets, the result is the same."""
    shared = " ".join(f"same{k}" for k in range(40))
    alone = {d: "\n".join(" ".join(f"own{d}x{k}y{i}" for i in range(30)) for k in range(5)) for d in range(20)}
    texts = {d: f"{t}\n{shared}\n" if d < 3 else t for d, t in alone.items()} | {20: None, 21: " \n", 22: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = sorted(map(tuple, rows_of(paragraphs.removals(df))), key=str)
    assert {r[0] for r in want if r[3]} == {1, 2}
    monkeypatch.setattr(paragraphs, "BUCKET", 50)
    assert sorted(map(tuple, rows_of(paragraphs.removals(df))), key=str) == want
    for r in rows_of(paragraphs.paragraphs(df.select(paragraphs._identity().alias("id"), "text"))):
        begin = len(alone[paragraphs._doc_id(bytes(r.id))]) if paragraphs._doc_id(bytes(r.id)) < 3 else None
        places = [(x.begin, x.end) for x in [*r.spans, *r.paragraphs]]
        assert (begin is not None) == bool(places)
        assert all(a >= begin for a, _ in places)


def test_near_duplicates_shuffle_texts_once(spark, monkeypatch):
    """Whatever a comparison asks for, the texts lie dealt by id already."""
    df = spark.createDataFrame([(k, " ".join(f"w{k // 2}x{i}" for i in range(50))) for k in range(20)], "doc_id long, text string")
    confirmed, seen = chosen_path.confirmed, []
    monkeypatch.setattr(chosen_path, "confirmed", lambda groups, classes, docs, *rest: seen.append(docs) or confirmed(groups, classes, docs, *rest))
    rows_of(chosen_path.near_duplicates(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [spark.range(5).join(docs, "id")._jdf.queryExecution().executedPlan().toString() for docs in seen]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans and all(plan.count("Exchange hashpartitioning(id") == 1 for plan in plans)


def test_pipeline_near_duplicates(spark):
    """One word of 40 is new: 33 of 41 four-word shingles are common, but only 31 of 41 five-word ones; of 60 words 51 of 61."""
    import corpus_pipeline

    rows = []
    for i, n in ((0, 40), (2, 60)):
        words = [f"w{i}x{k}" for k in range(n)]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words[: n // 2], "new", *words[n // 2 + 1 :]]))]
    for (_, a), (_, b), size, alike in ((*rows[:2], 4, True), (*rows[:2], 5, False), (*rows[2:], 5, True)):
        x, y = shingled(a, size), shingled(b, size)
        assert (100 * len(x & y) >= 80 * len(x | y)) == alike
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in rows_of(kept)) == [0, 1, 2]


def test_pipeline(spark, docs, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "packing"]
    held, before = docs, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, sf)
        assert held.columns == docs.columns and 0 < held.count() <= before
        before = held.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, held, sf)
    assert packed.select("doc_id").distinct().count() == held.select("doc_id").distinct().count()
