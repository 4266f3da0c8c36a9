"""Document operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.llm import graph, licenses, media, mixing, near_dedup, pii, quality, sentence_pieces, shingles

DOCS = "doc_id long, text string, lang string, source string"
SPECIAL = [(-1, None), (-2, ""), (-3, "   \n\t"), (-4, "one"), (-5, "x" * 70_000), (-6, "a b " * 20_000)]


def frame(spark, texts):
    """Documents with clashing extra columns; ids from the list or by position."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("key", "node", "n", "kept", "found", "component_id", "score", "band")})


def variants(seed, bases=12, copies=6):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(bases):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 8, 40, 90]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rnd.randint(0, 6)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            out.append(" ".join(t))
    return out


def brute(texts, width, percent=80):
    def of(t):
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {i: of(t) for i, t in texts}
    ids = sorted(sets)
    up = graph.contracted((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    return {i: (len(sets[i]), up.get(i, i), up.get(i, i) == i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_equals_brute_force(spark, width):
    texts = [*enumerate(variants(4)), *SPECIAL, (900, "Same Text here"), (901, "same\ttext\nhere")]
    got = near_dedup.link_documents(frame(spark, texts), width=width).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(texts, width)


def test_near_dedup_null_ids_repeats_and_empty(spark):
    got = near_dedup.link_documents(frame(spark, [(None, "a b c"), (3, "a b c"), (3, "a b c"), (7, "a b c")]), width=2).collect()
    assert sorted(tuple(r) for r in got if r[0] is not None) == [(3, 2, 3, True), (3, 2, 3, True), (7, 2, 3, False)]
    assert [tuple(r) for r in got if r[0] is None] == [(None, 2, None, True)]
    assert near_dedup.link_documents(frame(spark, []).limit(0), width=2).count() == 0


def test_keep_one(spark):
    kept = near_dedup.keep_one(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other"), (4, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and set(tuple(kept.first())[2:]) == {"clash"}


def test_registers_merge_and_estimate():
    rnd = np.random.Generator(np.random.PCG64(1))
    sketch = shingles.SetSketch(400)
    a, b = rnd.integers(0, 1 << 62, 900).astype(np.uint64), rnd.integers(0, 1 << 62, 300).astype(np.uint64)
    x, y = np.concatenate([a[:800], b[:50]]), a
    assert (sketch.of(np.concatenate([x, y])) == np.maximum(sketch.of(x), sketch.of(y))).all()
    est = sketch.similarity(sketch.of(x)[None], sketch.of(y)[None], np.array([850.0]), np.array([900.0]))[0]
    assert est == pytest.approx(800 / 950, abs=0.06)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)]
    want = graph.contracted(edges)
    df = spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")
    assert dict(tuple(r) for r in graph.components(df).collect()) == want
    was, graph.EDGES_A_TASK = graph.EDGES_A_TASK, 7
    try:
        assert dict(tuple(r) for r in graph.components(df).collect()) == want
    finally:
        graph.EDGES_A_TASK = was


PII_TEXTS = [
    (1, "a@b.c@d.e a@b.c%x@y.z é😀 x@y.zz +12 3456 7890 +1234567-8"), (2, "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.01"),
    (3, "4111 1111 1111 1111-2 4111-1111-1111-1111 4111111111111111 "), (4, "1-2-" * 20_000), (5, "+1" + "(" * 20_000 + "2 +1(((((2345678"), (6, "a." * 20_000 + "@" + "b." * 20_000),
    (7, 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" for SSN 123-45-6789'), (8, "call (212) 555-1234 Mr. John Smith"),
]


def base_spans(t):
    def luhn(h):
        ds = [int(x) for x in re.sub("[^0-9]", "", h)][::-1]
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(ds)) % 10 == 0

    digits = lambda h: len(re.sub("[^0-9]", "", h))
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(x) <= 255 for x in h.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 16 <= digits(h) <= 19 and luhn(h)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 8 <= digits(h) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m[0])]


def test_pii_base_equals_brute_force(spark):
    texts = [*PII_TEXTS, *SPECIAL]
    slow = {6}  # the plain pattern backtracks for minutes
    got = {r["doc_id"]: r["found"] for r in pii.find_pii(frame(spark, texts)).collect()}
    for i, t in texts:
        if i not in slow:
            assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["base"]] == base_spans(t), i
    assert {s["kind"] for s in got[7]} >= {"secret"}


def test_pii_redaction(spark):
    docs = frame(spark, [*PII_TEXTS[:1], (7, "mail me@site.org now"), (8, None)])
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got[7] == "mail <EMAIL> now" and got[8] is None and "@b.c" not in got[1]
    assert pii.redact(docs.limit(0)).count() == 0


def planted(n=60):
    """Texts with one span each: (kind, text, whether it is personal data)."""
    rnd = random.Random(5)
    some = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    num = lambda k: some("0123456789", k)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    out = []
    for i in range(n):
        out.append(("secret", f'the token = "{some("0123456789abcdef", 38)}a1" was found', True))
        out.append(("secret", f"api_key: sk-{some(alnum, 28)}a1B then", True))
        out.append(("secret", f"see commit {some('0123456789abcdef', 38)}a1 for it", False))
        out.append(("secret", f"a slug like-this-long-title-of-{1900 + i}-for-you stands", False))
        out.append(("ssn", f"his SSN {100 + i}-{num(1)}3-{num(3)}4 is", True))
        out.append(("ssn", f"order {900 + i % 90}-00-{num(4)} came", False))
        out.append(("local_phone", f"call (2{num(2)}) 555-{num(4)} now", True))
        out.append(("iban", f"IBAN DE{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", True))
        out.append(("person", f"signed, Dr. {rnd.choice(['Maria', 'John', 'Anna'])} {some('BCDFG', 1)}{some('aeiou', 5)}", True))
        out.append(("none", "only a short text with 12 words", False))
    return out


def test_votes_accept_planted_spans(spark):
    texts = planted()
    got = {r["doc_id"]: {s["kind"] for s in r["found"]} for r in pii.find_pii(frame(spark, [t for _, t, _ in texts])).collect()}
    for kind in {k for k, _, true in texts if true}:
        own = [(kind in got[i], true) for i, (k, _, true) in enumerate(texts) if k == kind]
        assert sum(hit for hit, true in own if true) >= 0.95 * sum(true for _, true in own), kind
        assert sum(hit for hit, true in own if not true) <= 0.05 * len(own), kind
    assert all(not got[i] for i, (k, _, _) in enumerate(texts) if k == "none")


def test_gazetteer_as_a_table(spark):
    names = spark.createDataFrame([("person", "Zebulon"), ("person", None), (None, "x")], "kind string, entry string")
    assert "zebulon" in pii.gazetteer_of(names)["person"] and "zebulon" not in pii.gazetteer_of(None)["person"]
    was, pii.ENTRIES = pii.ENTRIES, 0
    try:
        with pytest.raises(ValueError):
            pii.gazetteer_of(names)
    finally:
        pii.ENTRIES = was
    assert pii.find_pii(frame(spark, ["Mr. Zebulon Pike", None]), entries=names).count() == 2


def test_votes_learn_reliability():
    """Of two labelers one follows the truth and one is noise."""
    rnd = random.Random(0)
    seen: dict = {}
    for _ in range(4000):
        true = rnd.random() < 0.3
        good = 1 if rnd.random() < (0.95 if true else 0.05) else -1
        also = 1 if rnd.random() < (0.9 if true else 0.1) else 0
        noise = rnd.choice([0, 1])
        k = ("k", good, noise, also, 0, 0)
        seen[k] = seen.get(k, 0) + 1
    patterns = sorted((*k, n) for k, n in seen.items())
    post = dict(zip(patterns, pii.reliabilities(patterns), strict=True))
    for p, q in post.items():
        if p[1] == 1 and p[3] == 1:
            assert q > 0.9
        if p[1] == -1 and p[3] == 0:
            assert q < 0.1


def test_forward_backward_equals_enumeration():
    rnd = np.random.Generator(np.random.PCG64(0))
    per = np.array([3, 1, 5])
    emit, step, start = rnd.standard_normal(9), rnd.standard_normal((2, 2)), rnd.standard_normal(2)
    p, log_z, moved = quality.marginals(emit, per, step, start)
    at, total = 0, np.zeros((2, 2))
    for c, n in enumerate(per):
        e = emit[at : at + n]
        weight = {}
        for k in range(1 << n):
            y = [(k >> i) & 1 for i in range(n)]
            weight[tuple(y)] = np.exp(start[y[0]] + sum(e[i] * y[i] for i in range(n)) + sum(step[y[i], y[i + 1]] for i in range(n - 1)))
        z = sum(weight.values())
        assert log_z[c] == pytest.approx(np.log(z))
        for i in range(n):
            assert p[at + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z)
        for y, w in weight.items():
            for i in range(n - 1):
                total[y[i], y[i + 1]] += w / z
        at += n
    assert moved == pytest.approx(total)


def clean(rnd):
    return "\n".join(" ".join(rnd.choice(["the", "river", "stone", "and", "quiet", "house", "light"]) for _ in range(rnd.randint(5, 12))) + "." for _ in range(rnd.randint(1, 5)))


def junk(rnd):
    t = clean(rnd)
    return rnd.choice([lambda: t.replace(" ", " | "), lambda: t.upper().replace(" ", "!! "), lambda: t.replace(" ", "$$$ ### "), lambda: " ".join(["same"] * 60)])()


def test_quality_held_out(spark):
    rnd = random.Random(8)
    texts = [(i, junk(rnd) if i % 4 == 0 else clean(rnd)) for i in range(300)]
    docs = frame(spark, [*texts, *SPECIAL])
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)], "doc_id long, quality int")
    field = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, field).collect()}
    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == int(i % 4 != 0) for i in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(texts) + len(SPECIAL)
    kept = quality.keep_good(docs, field)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got.values())


def test_quality_without_labels(spark):
    docs = frame(spark, SPECIAL)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.LineField()).count() == 0


@pytest.mark.parametrize("n", [1, 15, 16, 17, 40])
def test_media_round_trip(n):
    payload = bytes(random.Random(n).randbytes(n * media.UNIT))
    data = media.encode(payload)
    found, error = media.tracks(data)
    assert error is None and media.payload_of(data, found[0]) == payload
    t = found[0]
    assert t["codec"] == "raw " and t["duration"] == t["ticks"] == len(payload) and len(t["sizes"]) == n
    assert t["keys"].tolist() == list(range(0, n, 16))
    assert [data[s : s + 4] for s in t["starts"][t["keys"]]] == [payload[k * 192 : k * 192 + 4] for k in range(0, n, 16)]


def test_media_of_other_shapes():
    box, full = media._box, media._full
    import struct

    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", b"\0" * 78)), full(b"stts", struct.pack(">III", 1, 4, 10)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">IIIIII", 0, 4, 5, 6, 7, 8)), full(b"co64", struct.pack(">IQQQ", 3, 1000, 2000, 3000)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIII", 0, 0, 90000, 40, 0)), box(b"minf", stbl))
    moov = box(b"trak", mdia)
    data = struct.pack(">I4sQ", 1, b"moov", len(moov) + 16) + moov
    t = media.tracks(data)[0][0]
    assert t["codec"] == "avc1" and t["starts"].tolist() == [1000, 1005, 2000, 3000] and t["keys"].tolist() == [0, 1, 2, 3]
    assert media.tracks(b"")[1] == "empty" and media.tracks(b"\0\0\0\x08moov")[1] == "no track"
    for cut in range(0, len(data), 7):
        media.tracks(data[:cut])


def test_media_query_columns(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "é" * 96), (4, "x" * 193), (None, "y")]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in media.op4_media(spark, str(tmp_path)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        full = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert got[1]["media_sha256"] == got[2]["media_sha256"]


def test_licenses_base_equals_brute_force(spark):
    texts = [*SPECIAL, (1, "Under the MIT  License, or the (GNU General-Public\nLicense) v3; mit license"), (2, "CC BY-NC 4.0 ccby 4.0"), (3, "amit license; Apache é license; Apache License, Version 2.0"), (None, "cc by"), (4, "mit" + " x" * 30_000 + " license")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    for i, t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_licenses_find_whole_notices(spark):
    texts = [(1, "Start. " + licenses.TEMPLATES["bsd"][0] + " end"), (2, "the following conditions and the use of source forms"), (3, licenses.TEMPLATES["mit"][0].replace("copy", "duplicate")), (4, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert got[1]["labels"] == "bsd" and got[1]["score"] == 1 and got[2]["labels"] == "" and "mit" in got[3]["labels"] and "cc-by-nc" in got[4]["labels"]


def test_pieces_equal_the_library_and_round_trip(spark):
    sp = pytest.importorskip("sentencepiece")
    model = sentence_pieces.read_model(sentence_pieces.MODEL)
    lib = sp.SentencePieceProcessor(model_proto=model)
    rnd = random.Random(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "ß", "22", "==", "...", "😀", "\t", "한", "    ", "aaaa", "xx", "​", "▁"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    texts += [t for _, t in SPECIAL]
    enc = sentence_pieces.encode(frame(spark, texts), model)
    got = {r["id"]: r["ids"] for r in enc.collect()}
    for i, t in enumerate(texts):
        assert got[i] == lib.encode(t or ""), repr(t)[:80]
    back = {r["id"]: r["text"] for r in sentence_pieces.decode(enc, model).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert sentence_pieces.encode(frame(spark, []).limit(0), model).count() == 0


def test_unigram_takes_the_least_weight():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", False, False, True
    m.trainer_spec.model_type = 1
    for piece, score, kind in (("<unk>", 0, 2), ("a", -3, 1), ("b", -3, 1), ("ab", -5, 1), ("abb", -9.5, 1), ("bb", -4, 1)):
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    t = sentence_pieces.Transducer(m.SerializeToString())
    assert t.encode("abb") == [1, 5] and t.encode("ab") == [3] and t.encode("xab") == [0, 3]


def mixed(spark, rows, **kw):
    docs = spark.createDataFrame(rows, DOCS).withColumn("share", F.lit("clash")).withColumn("tokens", F.lit(1))
    return docs, mixing.mix(docs, **kw)


def test_mixing_budgets(spark):
    leaves = spark.createDataFrame([("d0", "en", "s4", 1000), ("d0", "en", "s8", 10), ("d0", "de", "s4", 500), ("d1", "en", "s1", 40)], "domain string, lang string, source string, tokens long")
    got = {tuple(r)[:3]: r["share"] for r in mixing.budgets(leaves, 700, {"domain": {"d0": 1, "d1": 1}, "lang": {}, "source": {}}, 1).collect()}
    # d1 can take 40 of its 350, d0 takes 660: 330 for each language; s8 takes 10 of its 165, s4 the rest
    assert got == {("d1", "en", "s1"): 40, ("d0", "de", "s4"): 330, ("d0", "en", "s8"): 10, ("d0", "en", "s4"): 320}


def test_mixing_prefixes_and_epochs(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)), rnd.choice(["en", "de", None]), rnd.choice(["src1", "src2", "x", None])) for i in range(400)] + [(1000, None, "en", "src1"), (None, "a b", "en", "src1")]
    docs, got = mixed(spark, rows, budget=4000)
    out = got.collect()
    assert got.columns[: len(docs.columns)] == docs.columns
    share = {}
    for r in out:
        key = (r["__domain"], r["__lang"], r["__source"])
        share.setdefault(key, {}).setdefault(r["__epoch"], []).append(r)
    sizes = {}
    for i, t, lang, src in rows:
        n = len((t or "").split())
        d = f"d{int(m[0]) % 4 if (m := re.findall('[0-9]{1,9}$', src or '')) else 0}"
        sizes.setdefault((d, lang or "", src or ""), []).append((i, n))
    budget = {tuple(r)[:3]: r["share"] for r in mixing.budgets(spark.createDataFrame([(*k, sum(n for _, n in v)) for k, v in sizes.items()], "domain string, lang string, source string, tokens long"), 4000, mixing.WEIGHTS, 2).collect()}
    assert sum(budget.values()) <= 4000
    for key, docs_of in sizes.items():
        total = sum(n for _, n in docs_of)
        whole, rest = divmod(budget[key], total) if total else (1, 0)
        order = sorted((hashlib.md5(f"{mixing.SEED}:{whole}:{'null' if i is None else i}".encode()).hexdigest(), i, n) for i, n in docs_of)
        want, upto = [], 0
        for _, i, n in order:
            upto += n
            if rest and upto <= rest:
                want.append(i)
        epochs = share.get(key, {})
        for e in range(whole):
            assert len(epochs.get(e, [])) == len(docs_of)
        assert sorted((r["doc_id"] for r in epochs.get(whole, [])), key=str) == sorted(want, key=str)


def test_mixing_empty(spark):
    assert mixed(spark, [])[1].count() == 0
def test_licenses_of_several_notices():
    index = licenses.compile_index()
    text = " and so on ".join(licenses.TEMPLATES[k][0] for k in ("mit", "bsd", "mpl", "proprietary"))
    mit = set(licenses.words_of(licenses.TEMPLATES["mit"][0]))
    idf = {w: 9.0 if w in mit else 1.0 for w in index["postings"]}
    assert licenses.scan(text, index, idf)[5] == "bsd,mit,mpl,proprietary"




def test_repeated_ids_with_different_texts(spark):
    """Id 5 has two texts, one like that of 7 and one like that of 9: all are one group in any order of rows."""
    rows = [(5, "a b c d e f"), (5, "u v w x y z"), (7, "a b c d e f"), (9, "u v w x y z"), (3, "not like any of them")]
    for order in (rows, rows[::-1]):
        got = near_dedup.link_documents(frame(spark, order), width=2).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]


def fragmented(sizes, marks, wide=False):
    """A file whose only samples lie in two movie fragments."""
    import struct

    box, full = media._box, media._full
    payload = bytes(i % 251 for i in range(sum(sizes)))
    head = media.encode(b"")  # a movie without samples
    at = head.index(b"moov") - 4
    moov = head[at : at + struct.unpack_from(">I", head, at)[0]]
    trex = full(b"trex", struct.pack(">IIIII", 1, 1, 10, 0, 0x10000))
    moov = box(b"moov", moov[8:], box(b"mvex", trex))
    out, done = media.FTYP + moov, 0
    for part in (slice(0, len(sizes) // 2), slice(len(sizes) // 2, None)):
        own, flags = sizes[part], marks[part]
        for offset in (0, 1):  # the first round finds the offset
            trun = full(b"trun", struct.pack(">Ii", len(own), offset), b"".join(struct.pack(">II", z, 0x2000000 if k else 0x10000) for z, k in zip(own, flags, strict=True)), flags=0x601)
            moof = box(b"moof", full(b"mfhd", b"\0\0\0\1"), box(b"traf", full(b"tfhd", struct.pack(">I", 1), flags=0x20000), trun))
            if not offset:
                size = len(moof) + 8
        moof = moof.replace(struct.pack(">Ii", len(own), 1), struct.pack(">Ii", len(own), size))
        out += moof + box(b"mdat", payload[done : done + sum(own)])
        done += sum(own)
    return out, payload


def test_media_fragments():
    data, payload = fragmented([7, 5, 9, 4, 6], [True, False, True, False, False])
    found, error = media.tracks(data)
    assert error is None and media.payload_of(data, found[0]) == payload
    assert found[0]["keys"].tolist() == [0, 2] and found[0]["sizes"].tolist() == [7, 5, 9, 4, 6] and found[0]["ticks"] == 50


def test_media_malformed(spark):
    good = media.encode(b"x" * 192 * 40)
    at = good.index(b"stsc")
    broken = [good[: at + 16] + b"\xff" * 4 + good[at + 20 :], good[: len(good) // 3], b"\0\0\0\1moof" + b"\xff" * 8, b"", None, fragmented([3, 4], [True, True])[0][:-30]]
    rnd = random.Random(3)
    for _ in range(300):
        raw = bytearray(rnd.choice([good, fragmented([5] * 6, [True] * 6)[0]]))
        for _ in range(rnd.randint(1, 4)):
            raw[rnd.randrange(min(len(raw), 900))] = rnd.choice([0, 1, 127, 255])
        broken.append(bytes(raw))
    for data in broken:
        found, _ = media.tracks(data)
        assert all(len(t["sizes"]) <= max(1, len(data)) for t in found)
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(broken[:6])] + [(None, good)], "id string, content binary")
    rows = media.inspect(df.withColumn("track", F.lit("clash")), "id", "content").collect()
    assert {r["id"] for r in rows} == {None, *map(str, range(6))} and next(r for r in rows if r["id"] == "4")["error"] == "empty"


def test_stored_texts_are_files(spark):
    got = {r["id"]: bytes(r["media"]) for r in media.store_texts(frame(spark, ["one", None, ""])).collect()}
    assert media.payload_of(got["0"], media.tracks(got["0"])[0][0]) == b"one" + b" " * 189 and got["1"] == got["2"]


def test_mixing_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s0"), (2, "c", None, None)], DOCS).withColumns({c: F.lit("clash") for c in ("__domain", "__tokens", "__epoch", "__whole", "__rest", "__order", "__id", "own 1")})
    got = mixing.mix(docs, budget=6).collect()
    assert {(r["doc_id"], r["__domain"], r["__tokens"], r["__whole"], r["own 1"]) for r in got} == {(1, "d0", 2, "clash", "clash"), (2, "d0", 1, "clash", "clash")}


def test_whole_notices(spark):
    names = ["mit-full", "bsd-full", "apache-full", "gpl-full", "mpl-full", "isc", "unlicense"]
    texts = [f"Some words. {licenses.TEMPLATES[n][0]} The end." for n in names] + ["\n".join(licenses.TEMPLATES[n][0] for n in names)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    for i, n in enumerate(names):
        assert licenses.label_of(n) in got[i]["labels"].split(",") and got[i]["score"] == 1, n
    assert set(got[len(names)]["labels"].split(",")) == {licenses.label_of(n) for n in names}
