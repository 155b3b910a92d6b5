"""The whole pipeline on small documents against plain Python, stage by stage."""

import hashlib
import random
import re

import numpy as np
import sentencepiece

import corpus_pipeline
from notecode.llm import language, mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = {
    "en": "the river and house are near old mill today which stands behind that green hill with many trees".split(),
    "fr": "la rivière et une maison sont près du vieux moulin qui reste derrière cette colline verte avec des arbres".split(),
    "de": "der fluss und das haus sind nahe bei einer alten mühle die hinter jenem grünen hügel mit bäumen steht".split(),
}


def documents():
    draw = random.Random(11)
    rows = []
    for k in range(90):
        lang = draw.choice(sorted(VOCABULARY))
        words = [draw.choice(VOCABULARY[lang]) for _ in range(draw.randint(8, 60))]
        if k % 7 == 0:
            words.insert(draw.randrange(len(words)), f"me{k}@site.org")
        if k % 11 == 0:
            words.insert(draw.randrange(len(words)), f"10.0.0.{k}")
        rows.append((k, " ".join(words), lang if k % 9 else None, draw.choice(["web", "web", "books", None])))
    for k in range(90, 110):  # near and exact copies
        _, text, lang, source = rows[draw.randrange(60)]
        words = text.split()
        if k % 2 and len(words) > 30:
            words[-1] = "changed"
        rows.append((k, " ".join(words), lang, source))
    rows += [(200, None, None, None), (201, "", "en", "web"), (202, "12 34 !!", "en", "web"), (203, "x" * 3000, "en", "books")]
    rows += [rows[5], rows[5], (rows[6][0], "a second text under the id of another one, about the old mill", "en", "web")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def in_known_language(rows):
    held_out = {r[0] for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 5 == 0}
    counts = {}
    for doc, text, lang, *_ in rows:
        if text is not None and lang is not None and doc not in held_out:
            points, _, places, bucket = language._coded([text])
            own = counts.setdefault(lang, {})
            for b in bucket.tolist():
                own[b] = own.get(b, 0) + 1
            for script in language._letters()[1][points[places]].tolist():
                own[script - len(language.SCRIPT_NAMES)] = own.get(script - len(language.SCRIPT_NAMES), 0) + 1
    flat = [(lang, b, n) for lang, own in counts.items() for b, n in own.items()]
    model = language.Model(*map(list, zip(*flat)))
    kept = []
    for row in rows:
        found, score, _ = language.label_texts(model, [row[1] or ""])[0]
        if found != language.UNKNOWN and score >= corpus_pipeline.LEAST_SCORE:
            kept.append((row[0], row[1], found, *row[3:]))
    return kept


def without_near_duplicates(rows):
    least = {}
    for row in rows:
        key = lambda r: (r[1] is None, r[1], r[2], (r[3] is not None, r[3] or ""), r[4])
        if row[0] not in least or key(row) < key(least[row[0]]):
            least[row[0]] = row
    docs = sorted(least.values())
    sets = []
    for _, text, *_ in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [row for k, row in enumerate(docs) if group[k] == k]


def masked(rows):
    kinds = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]"), (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "[IP]")]
    out = []
    for doc, text, lang, source, n in rows:
        new = text
        for pattern, name in kinds:
            new = re.sub(pattern, name, new)
        out.append((doc, new, lang, source, len(new) if new != text else n))
    return out


def mixed(rows):
    """Each row as often as weighted fair queues take it within the budget."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows]
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for r, n in zip(rows, sizes) if r[3] == s) for s in order}
    weight, target = dict(zip(order, [5, 2, 1] * len(order))), {}
    while len(target) < len(order):
        rest = [s for s in order if s not in target]
        level = (sum(sizes) - sum(target.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if level * weight[s] > mixing.MOST_LAPS * total[s]]
        target.update({s: mixing.MOST_LAPS * total[s] for s in above} if above else {s: level * weight[s] for s in rest})
    queue = []
    for s in order:
        own = sorted((md5(md5(str(r[0])) + md5(r[1])), k) for k, r in enumerate(rows) if r[3] == s and sizes[k])
        for lap in range(mixing.MOST_LAPS):
            so_far = 0
            for key, k in own:
                so_far += sizes[k]
                queue.append(((lap * total[s] + so_far) / target[s], s is not None, s or "", key, k))
    out, used = [], 0
    for *_, k in sorted(queue):
        used += sizes[k]
        if used > sum(sizes):
            break
        out.append(rows[k])
    return out


def encoded(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.model_path())
    out = []
    for doc, text, *_ in rows:
        ids = model.encode(text, add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        out.append((doc, len(ids), digest, hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    return out


def test_run_equals_plain_python(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = without_near_duplicates(in_known_language(rows))
    assert 60 < len(kept) < 100
    expected = encoded(mixed(masked(kept)))
    found = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
