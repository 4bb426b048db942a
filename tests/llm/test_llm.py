"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tallyloom.llm import chat_format, decontaminate, elias_fano, hmm_scores, license_scan, near_dedup, quality_classifier, quality_rules, secrets, sentencepiece_scan, token_output
from tallyloom.llm.components import components
from tallyloom.llm.trigram_query import ANY, trigram_query

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, node string, kept string, block string"


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(("oak", "Elm", "ash,", "fir.", "yew", "été")) + str(r.randrange(40)) for _ in range(n))


def rows():
    base = prose(1, 60)
    near = base.split(" ")
    near[30] = "changed"
    texts = [None, "", "   \n", "one two", "one two", base, base, " ".join(near), prose(2, 9000), prose(3, 300), "x" * 5000, "a b c d e f g h " * 12, "Grüße 🙂 token = \"abcdef123\" AKIA" + "A1" * 10, "### $$$ ||| " * 30, base.upper(), "line here\nline here\nother\nReleased under the MIT License."]
    out = [(i, t, "n", "k", "b") for i, t in enumerate(texts)]
    return [*out, out[5], (None, base, "n", "k", "b"), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(50)], "u long, v long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert {found[n] for n in (1, 2, 3)} == {1} and {found[n] for n in (7, 8, 9)} == {7} and {found[100 + i] for i in range(51)} == {100} and 5 not in found


def test_near_duplicates(spark, docs, empty):
    more = [(1000 + i, " ".join(f"w{(j * 7 + (i if j % 25 == i % 25 else 0)) % 997}" for j in range(120)), "", "", "") for i in range(40)]
    table = docs.union(spark.createDataFrame(more, SCHEMA))
    sets = []
    for r in table.collect():
        w = SPACE.findall(low(r.text))
        sets.append((r.doc_id, frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted((str(d), len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))
    got = near_dedup.near_duplicates(table).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.deduplicated(table)
    assert kept.columns == table.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id in (6, 7)").count() == 0


def test_trigram_queries():
    assert trigram_query("[0-9a-f]{24,}") == ANY
    assert trigram_query("abc(def|x)?g") == frozenset([frozenset(["abc", "bcg"]), frozenset(["abc", "bcx", "cxg"]), frozenset(["abc", "bcd", "cde", "def", "efg"])])
    for text, pattern in (("xx PassWd: 12", r"(?i)(password|passwd)\s*[:=]"), ("ghp_" + "a" * 40, r"gh[pousr]_[A-Za-z0-9]{36,}")):
        found = re.search(pattern, text)[0].lower()
        assert any(all(t in found for t in a) for a in trigram_query(pattern))


def test_secrets(spark, docs, empty):
    extra = ["secret:token:abcdefg", "token=token=abcdefgh", "API_KEY = 'abc' apikey=\"abcdef\"", "AKIA" + "Z" * 15 + " AKIA" + "Z" * 16, "0" * 23 + "g" + "0123456789abcdef" * 3, "é" * 9 + "password:" + " " * 3 + "=x secret=éé", "🙂password=longenough🙂" * 3]
    table = docs.union(spark.createDataFrame([(500 + i, t, "", "", "") for i, t in enumerate(extra)], SCHEMA))
    kinds = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    got = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.secret_digest(table).collect())
    want = collections.Counter()
    for r in table.collect():
        spans = sorted((m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(kinds) for m in re.finditer(p, r.text or "", re.A | (re.I if k == "assign" else 0)) if len(m[g]) >= n)
        count = collections.Counter(s[3] for s in spans)
        want[r.doc_id, count["assign"], count["access"], count["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()] += 1
    assert got == want
    assert secrets.secret_digest(empty).count() == 0
    clean = secrets.redact(table)
    assert clean.columns == table.columns and clean.count() == table.count()
    assert not any("abcdef123" in (r.text or "") or "longenough" in (r.text or "") for r in clean.collect())


def test_contamination(spark, docs, empty):
    items = [(1, prose(9, 30)), (2, "Short item here"), (3, None), (None, "one two"), (10, prose(2, 9000)[200:600]), (11, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = docs.union(spark.createDataFrame([(700, "before " + prose(9, 30) + " after", "", "", ""), (701, "a SHORT, item; here now", "", "", "")], SCHEMA))
    windows = collections.defaultdict(set)
    for name, text in items:
        w = ALNUM.findall(low(text))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].update([str(name)] if name is not None else [])
    want = []
    for r in table.collect():
        w, hit, found = ALNUM.findall(low(r.text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        want.append((str(r.doc_id), len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontaminate.contamination(table, benchmark).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == sorted(want)
    assert all(set(r["items"]) <= set(r.near_items) for r in got)
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(table, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminated(table, benchmark).where("doc_id in (700, 701)").count() == 0
    swapped = prose(9, 30).split(" ")
    swapped[14], swapped[15] = swapped[15], swapped[14]
    near = decontaminate.contamination(spark.createDataFrame([(1, " ".join(swapped[9:22]))], "doc_id long, text string"), benchmark).first()
    assert list(near["items"]) == [] and list(near.near_items) == ["1"]


def test_quality_rules(docs, empty):
    want = []
    for r in docs.collect():
        w = SPACE.findall(r.text or "")
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = collections.Counter(grams)
        repeated = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if SPACE.search(x)]
        want.append((str(r.doc_id), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w)))
    got = quality_rules.quality_rules(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    verdicts = sorted((str(r.doc_id), r.kept) for r in got)
    for order in (quality_rules.RULES, quality_rules.RULES[::-1]):
        assert sorted((str(r.doc_id), r.kept) for r in quality_rules.quality_rules(docs, order).collect()) == verdicts
    assert quality_rules.quality_rules(empty).count() == 0


def test_elias_fano():
    r = random.Random(4)
    for values in ([], [0], [7], [0, 0, 5, 5, 5, 10**12], sorted(r.randrange(10**6) for _ in range(3000)), list(range(1000))):
        coded = elias_fano.EliasFano(elias_fano.encode(np.array(values, dtype=np.uint64)) + b"rest")
        assert coded.all().tolist() == values and [coded.select(i) for i in range(len(values))] == values
    assert len(elias_fano.encode(np.arange(0, 10**6, 50))) < 20_000 * 1.2


def test_token_output(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["it's I'LL <|endoftext|> x<|endoftext|>y", "été İstanbul ΑΣ ß ½ 12 3", "a b　c\x1cd\x85e ﬁ", "don't — “quoted” 日本語 🙂🙂"]
    table = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).union(spark.createDataFrame([(-5 - i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA))
    start, want = 0, []
    for r in sorted(table.collect(), key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_output.token_output(table, path).collect()) == want
    assert token_output.token_output(empty, path).count() == 0
    assert token_output.token_output(docs, path).count() == docs.count()
    files = sorted(r.file for r in token_output.export(token_output.shards(table, path), str(tmp_path)).collect())
    shard = token_output.Shard(open(files[0], "rb").read())
    assert shard.doc_ids()[0] == want[0][0] and len(shard.document(1)) == want[1][2]


def test_sentencepiece(spark, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    extra = ["▁ literal ▁▁", "  two  blanks ", "\udbff".encode("utf-16", "surrogatepass").decode("utf-16", "ignore") + "日本語テキスト" * 30, "\n\n\t"]
    table = docs.union(spark.createDataFrame([(800 + i, t, "", "", "") for i, t in enumerate(extra)], SCHEMA))
    whole = sentencepiece_scan.sentencepiece_digest(table, path).collect()
    assert all(r.round_trip for r in whole) and len(whole) == table.count()
    for chunk in (37, 1000):
        assert sorted(map(str, sentencepiece_scan.sentencepiece_digest(table, path, chunk).collect())) == sorted(map(str, whole))
    pieces = sentencepiece_scan.Pieces(sentencepiece_scan.read_model(path))
    for r in table.where("length(text) < 400").collect():  # one path over the whole text, without cuts
        text = sentencepiece_scan.escape(" " + r.text) if r.text else ""
        ids = np.array(pieces.best(text)[1], dtype="<u4") if text else np.zeros(0, dtype="<u4")
        assert any(w.doc_id == r.doc_id and w.ids_crc32 == zlib.crc32(ids.tobytes()) for w in whole)
    assert sentencepiece_scan.sentencepiece_digest(empty, path).count() == 0


def test_sentencepiece_equals_the_library_for_a_unigram_model():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -float(6 + int(8 * math.log2(i + 2)))
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    pieces = sentencepiece_scan.Pieces([(p.piece, p.score, p.type) for p in model.pieces])
    for i in range(40):
        text = prose(i, 6).replace("été", "the")
        ids = pieces.best(sentencepiece_scan.escape(" " + text))[1]
        score = lambda x: sum(pieces.score[model.pieces[k].piece] for k in x)
        assert score(ids) == score(library.encode(text)) and pieces.decode(np.array(ids)) == text


def test_chat_format(spark):
    said = "</s>[INST] ok [/INST]"
    r = random.Random(3)
    turns = [(-1, 0, "user", said), (-1, 1, "assistant", said), (2, 0, "system", "Be kind."), (3, None, None, None), (None, 1, "user", "<|end|> %25 % <|turn|>"), (None, 2, "assistant", "%3C|end|> <<SYS>>")]
    turns += [(2, i, ("user", "assistant")[i % 2 == 0], prose(i, r.choice((0, 5, 40, 700)))) for i in range(1, 60)]
    turns += [(4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (4, 1, "user", "other")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    formatted = chat_format.windows(table, budget=300)
    assert formatted.where("n_tokens > 300 and n_new > 1").count() == 0 and formatted.where("conv_id = 2").count() > 5
    assert formatted.where("conv_id = 2 and n_repeated > 0 and not formatted like '<|turn|>system<|text|>Be kind.%'").count() == 0
    want = {}
    for key in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == key), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        learnt = "".join(t[3] or "" for t in own if t[2] == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[key] = (len(own), digest("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)), len(learnt), digest(learnt))
    got = chat_format.read_back(formatted).collect()
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in got} == want
    assert chat_format.read_back(chat_format.windows(table.limit(0))).count() == 0


def test_redact_takes_whole_private_keys(spark):
    begin, end, body = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\n".join(["MIIEow" + "Qx9/+" * 11] * 30 + ["Zm9v"])
    texts = [f"a\n{begin}\n{body}\n{end}\nb", f"a {begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0AF1\n\n{body}==\n{end} b", f"a\n{begin}\n{body}\nplain words, after it", f"a {begin} b.", f"a {begin}\n{body}\n{end} mid. {begin}\n{body}\n{end} b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(rows).collect()}
    assert got == {0: "a\n[private_key]\nb", 1: "a [private_key] b", 2: "a\n[private_key]plain words, after it", 3: "a [private_key] b.", 4: "a [private_key] mid. [private_key] b"}


def test_lm_scores(docs, empty):
    count, ends = collections.Counter(), 0
    for r in docs.collect():
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            count.update(SPACE.findall(low(r.text)))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    got = hmm_scores.lm_scores(docs).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for r in docs.collect():
        w = SPACE.findall(low(r.text))
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert any((x.n_tokens, x.n_known, x.train_tokens) == (len(w) + 1, sum(count[y] > 0 for y in w) + 1, n) and abs(x.base_score - base) < 1e-6 and x.score < 0 for x in by[r.doc_id])
    assert hmm_scores.lm_scores(empty).count() == 0


def test_forward_recursion_is_exact():
    r = np.random.default_rng(1)
    k, c = hmm_scores.STATES, 5
    draw = lambda *s: (x := r.uniform(0.1, 1, s)) / x.sum(axis=-1, keepdims=True)
    model = hmm_scores.Hmm(draw(k), draw(k, k), draw(k, c))
    texts = [[0], [1, 2, 3], [4, 4, 0, 1, 2]]
    classes, size = np.array(sum(texts, [])), np.array([len(t) for t in texts])
    found = hmm_scores.likelihood(model, classes, np.cumsum(size) - size, size)
    for t, x in zip(texts, found, strict=True):
        total = sum(model.start[p[0]] * model.emit[p[0], t[0]] * math.prod(model.move[p[i - 1], p[i]] * model.emit[p[i], t[i]] for i in range(1, len(t))) for p in itertools.product(range(k), repeat=len(t)))
        assert abs(math.log10(total) - x) < 1e-9
    counts = hmm_scores.expected(model, classes, np.cumsum(size) - size, size)
    assert abs(counts[:k].sum() - 3) < 1e-9 and abs(counts[k : k + k * k].sum() - 6) < 1e-9 and abs(counts[k + k * k : -2].sum() - 9) < 1e-9
    assert abs(counts[-2] - found.sum()) < 1e-9 and counts[-1] == 9


def test_training_carries_the_state_over_run_borders():
    r = np.random.default_rng(2)
    k, c = hmm_scores.STATES, 9
    draw = lambda *s: (x := r.uniform(0.01, 1, s)) / x.sum(axis=-1, keepdims=True)
    model = hmm_scores.Hmm(draw(k), draw(k, k), draw(k, c))
    width = np.array([3 * hmm_scores.RUN + 17, 1, hmm_scores.RUN, 40, hmm_scores.RUN + 1])
    classes = r.integers(0, c, width.sum())
    whole = hmm_scores.expected(model, classes, np.cumsum(width) - width, width)
    runs = hmm_scores.expected(model, classes, *hmm_scores._runs(width))
    assert np.allclose(runs, whole, rtol=1e-9, atol=1e-9)
    assert abs(runs[:k].sum() - len(width)) < 1e-6 and abs(runs[k : k + k * k].sum() - (width - 1).sum()) < 1e-6


def test_training_sees_all_blocks_in_any_order(spark):
    """A first block of one held-out text, and blocks of different words."""
    held = next(i for i in range(100) if not hmm_scores._learnt(i))
    learnt = [i for i in range(1000) if hmm_scores._learnt(i)]
    r, rows = np.random.default_rng(3), []
    for ids, low_, high in (([held], 0, 20), (learnt[:30], 0, 200), (learnt[30:60], 150, 400)):
        width = np.array([50] * len(ids))
        rows.append((ids, bytearray(width.tobytes()), bytearray(r.integers(low_, high, width.sum()).astype(np.uint16).tobytes())))
    share = np.full(hmm_scores.CLASSES, 1 / hmm_scores.CLASSES)
    fits = [hmm_scores.fit(spark.createDataFrame(x, "doc_ids array<long>, lengths binary, classes binary").coalesce(1), share) for x in (rows, rows[::-1], rows[1:])]
    for other in fits[1:]:
        assert np.allclose(fits[0].move, other.move, atol=1e-6) and np.allclose(fits[0].emit, other.emit, atol=1e-8)


def test_quality_classifier(spark, docs, empty):
    good = [(i, prose(i, 80), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(x + "###" for x in prose(i, 80).split()), 0) for i in range(150)]
    table = spark.createDataFrame([x[:2] for x in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2], 0) for x in good + bad] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(table, labels).collect()}
    held = [x for x in good + bad if got[x[0]].held_out]
    assert held and all(got[x[0]].predicted == x[2] for x in held) and all(0 <= r.score <= 1 for r in got.values())
    assert all(0 <= r.score <= 1 for r in quality_classifier.quality_scores(docs, labels).collect())
    assert {r.score for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(empty, labels).count() == 0
    assert quality_classifier.accepted(table, labels).where("doc_id >= 1000").count() < 5


def test_pool_adjacent():
    assert quality_classifier.pool_adjacent(np.array([1.0, 1, 2]), np.array([1.0, 0, 2])).tolist() == [0.5, 0.5, 1.0]


def test_licenses(spark, docs, empty):
    s = license_scan.SENTENCES
    mit = ". ".join(s[x] for x in ("mit-grant", "mit-copies", "mit-as-is", "mit-liable")) + "."
    wrapped = "Intro text\n\n" + re.sub(r"(.{40}) ", r"\1\n", mit)
    texts = ["Some words.\nLicensed under CC BY-NC 4.0.", mit, wrapped, "The MIT License is nice.", s["mit-copies"] + ". " + s["mit-grant"], "étés. Released under the MIT License. Licensed under the Apache License, Version 2.0."]
    table = docs.union(spark.createDataFrame([(900 + i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA))
    got = {r.doc_id: r.licenses for r in license_scan.license_digest(table).collect()}
    assert [got[900 + i] for i in range(6)] == ["CC-BY-NC-4.0", "MIT", "MIT", "", "", "Apache-2.0,MIT"] and got[15] == "MIT"
    spans = next(r.found for r in license_scan.license_scan(table).collect() if r.doc_id == 905)
    assert texts[5][spans[0].start : spans[0].end] == "Released under the MIT License"
    assert license_scan.license_digest(empty).count() == 0
