"""Personal data in free text: found by a trained character tagger, replaced by typed placeholders."""

from __future__ import annotations

import hashlib
import io
import json
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphdrift.llm.tagger import KINDS, Alphabet, decode_runs, initial, margins, spans, train, window_scores
from glyphdrift.session import ensure_checkpoint_dir, materialise

WINDOW, STEP = 160, 120  # characters of a window to train on, and from one window's start to the next's
SCORED, AHEAD = 840, 800  # the same of the windows that are scored
#: Bounds of the labelled sample, whatever the size of the table.
SAMPLE_DOCUMENTS, LABELLED_WINDOWS, OTHER_WINDOWS = 10_000, 4_000, 5_000
VARIANTS = 6  # training examples of a labelled window, all but one with invented values
BLOCK = 600_000  # characters of the texts that are scored and decoded at a time
CROP = 90  # characters of a training example
ROUNDS = 1300
MARGIN = 2.0  # least score of a mention above "outside", names apart, which are held against the known parts

WIDE = re.compile("[\uff01-\uff5e\u3000\xa0]")
WIDTH = np.arange(0x10001, dtype="<u4")
WIDTH[0xFF01:0xFF5F], WIDTH[[0x3000, 0xA0]] = np.arange(0x21, 0x7F), 0x20


def fold(text: str) -> str:
    """Full-width forms and odd spaces as ordinary ones; every character keeps its place."""
    if text.isascii() or not WIDE.search(text):
        return text
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 0x10000, WIDTH[np.minimum(codes, 0x10000)], codes).tobytes().decode("utf-32-le", "surrogatepass")


# Patterns that label the training texts; they take no part in the search.
HAN = "[㐀-鿿]"
AT, DOT = r"(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?)", r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)"
EMAIL = re.compile(rf"[A-Za-z0-9](?:[\w+\-]|\.(?=\w))*{AT}[A-Za-z0-9\-]+(?:{DOT}[A-Za-z0-9\-]+)+", re.ASCII | re.IGNORECASE)
PHONE = re.compile(
    r"(?<![\w.+/-])(?:\+\d{1,3}[\s.(/-]{0,2}\d[\d\s().\/-]{5,16}\d|\+\d{8,14}|00\d{2}-\d{2,4}-\d{3,4}-\d{3,4}|\(0\d{1,4}\)\s?\d{3,4}[\s-]\d{3,4}"
    r"|\d{3}([-.])\d{3}\1\d{4}|0\d{2,4}/\d{6,9}|0\d([. -])\d\d\2\d\d\2\d\d\2\d\d)(?![\w-]|[./]\d)",
    re.ASCII,
)
ID_NUMBER = re.compile(r"(?<![\w.+/-])(?:\d{3}-\d{2}-\d{4}|\d{17}[\dXx]|[A-Z]{2}\d{7}|[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-Z]|\d{8}-[A-Z])(?![\w-])", re.ASCII)
NUMERAL = "(?:\\d{1,4}|[〇零一二三四五六七八九十百]{1,6})"
CAPITAL = r"[A-ZÀ-ÖØ-Þ][\wß-öø-ÿ'’-]*"
ADDRESS = re.compile(
    "|".join(
        (
            rf"(?:(?:Flat|Unit|Apartment|Apt\.?|Suite|Room)\s\w{{1,4}},\s)?\b\d{{1,4}}[a-z]?\s(?:{CAPITAL}\s){{1,3}}(?:Lane|Street|Avenue|Terrace|Close|Court|Row|Drive|Walk|Road|Way|Place|Square|Hill|Gardens|Crescent)\b|(?:(?:Flat|Unit)\s\w{{1,4}},\s)?\b\d{{1,4}}\s(?:Rope Walk|{CAPITAL}\sWalk)\b",
            rf"(?:\b(?:Am|An der|Im|Alte[rs]?|Neue[rs]?|Zum|Zur|Obere[rs]?|Untere[rs]?)\s)?\b{CAPITAL}(?:straße|strasse|gasse|allee|weg|platz|hof|steig|ufer|damm|ring|graben)\s\d{{1,4}}[a-z]?\b",
            rf"\b(?:Am|An der|Im|Zum|Zur)\s{CAPITAL}\s\d{{1,4}}[a-z]?\b",
            r"\b\d{1,4}(?:\s(?:bis|ter))?,\s(?:rue|avenue|impasse|quai|allée|place|chemin|boulevard|cours|passage|sentier|ruelle)\s[^,.;\n]{3,40}",
            r"\b(?:Calle|Paseo|Plaza|Avenida|Camino|Ronda|Travesía|Callejón|Carrera|Cuesta)\s(?:(?:del?|la|las|los|el)\s)*(?:[A-ZÁÉÍÓÚÑ]\w+\s?){1,3},\s\d{1,4}",
            rf"{HAN}{{2}}[縣市鎮區鄉州府]{HAN}{{2,4}}[街路巷坊道里弄]{NUMERAL}[號号]",
        )
    )
)
WORD = r"(?:[A-ZÀ-Þ][a-zß-ÿ]+|[A-ZÀ-Þ]{2,})(?:-(?:[A-ZÀ-Þ][a-zß-ÿ]+|[A-ZÀ-Þ]{2,}))?"
UPPER = r"[A-ZÀ-Þ]{2,}(?:-[A-ZÀ-Þ]{2,})?"
LATIN_NAME = re.compile(rf"(?<![\w@.+-])(?:(?:[A-Z]\.\s){{1,2}}{WORD}|{UPPER},\s{WORD}|{WORD}\s(?:[A-Z]\.\s)?{WORD})(?![\w@-])")
HAN_NAME = re.compile(rf"(?:^|(?<=[，,。；;：:、\n\s])|(?<=者)|(?<=存))(?=({HAN})({HAN}{{2}}))")


class Names:
    """Known name parts: a given list and the partners that its members are seen with in the texts."""

    def __init__(self, parts: list[tuple[str, str]]) -> None:
        self.latin = {p.lower() for p, _ in parts if p.isascii()}
        self.family = {p.lower() for p, k in parts if p.isascii() and k == "family"}
        self.han_family = {p for p, k in parts if not p.isascii() and k == "family" and len(p) == 1}
        self.han_given: set[str] = {p for p, k in parts if not p.isascii() and k == "given"}

    def learn(self, texts: list[str]) -> None:
        """Add parts that stand beside a known part in several names, and pairs of characters behind several families."""
        beside: dict[str, set[str]] = {}
        behind: dict[str, set[str]] = {}
        for text in texts:
            for m in LATIN_NAME.finditer(text):
                words = [w for w in re.split(r"[\s,]+", m.group()) if len(w.rstrip(".")) > 1]
                if len(words) == 2 and sum(w.lower() in self.latin for w in words) == 1:
                    known, new = (words[0], words[1]) if words[0].lower() in self.latin else (words[1], words[0])
                    beside.setdefault(new.lower(), set()).add(known.lower())
            for m in HAN_NAME.finditer(text):
                if m[1] in self.han_family:
                    behind.setdefault(m[2], set()).add(m[1])
        self.latin |= {w for w, k in beside.items() if len(k) >= 2}
        self.han_given |= {g for g, k in behind.items() if len(k) >= 2}
        families = Counter()
        for text in texts:
            for m in HAN_NAME.finditer(text):
                families[m[1]] += m[2] in self.han_given
        self.han_family |= {f for f, n in families.items() if n >= 3}


def labels(text: str, names: Names) -> tuple[list[tuple[int, int, str]], bool]:
    """Labelled spans of a folded text, and whether it also holds what may be a name but is not known to be one."""
    out: list[tuple[int, int, str]] = []
    doubt = False
    for kind, pattern in (("email", EMAIL), ("id_number", ID_NUMBER), ("phone", PHONE), ("address", ADDRESS)):
        for m in pattern.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b, _ in out):
                out.append((m.start(), m.end(), kind))
    for m in LATIN_NAME.finditer(text):
        if any(a < m.end() and m.start() < b for a, b, _ in out):
            continue
        words = [w.lower() for w in re.split(r"[\s,]+", m.group()) if len(w.rstrip(".")) > 1]
        known = [w in names.latin for w in words]
        if all(known):
            out.append((m.start(), m.end(), "person"))
        elif any(known):
            doubt = True
    for m in HAN_NAME.finditer(text):
        if m[2] in names.han_given and m[1] in names.han_family:
            out.append((m.start(1), m.end(2), "person"))
        elif m[2] in names.han_given:
            doubt = True
    return sorted(out), doubt


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that cover a text."""
    return list(range(0, max(1, len(text) - WINDOW + STEP), STEP))


#: What most mentions have, by which windows are chosen to train on: an at sign, a longer or divided number, a house number, an initial, or Han text.
LIVE = re.compile(rf"@|[(\[]at[)\]]|\d{{3}}|\d\s?[-./(),]|\d\s(?:bis|ter)\b|[\wß]\s\d{{1,4}}[a-z]?(?:[.,;]|\serb)|[A-Z]\.\s[A-Z]|{HAN}")
#: Or two capitalised words, or a number before one; such words that are stock phrases of the texts are passed over.
PAIR = re.compile(rf"(?:({WORD}),?\s(?:[A-Z]\.\s)?(?={WORD}))|(?:\d[a-z]?\s([A-ZÀ-Þ][\w]*))")
#: Capitalised words that begin German, English, French and Spanish sentences before another such word.
OPENERS = frozenset("der die das den dem ein eine einen am im in an auf vor nach während eines zum zur vom bei the a an two both nobody le la les un une du des au à el los las".split())
STOCK_WINDOWS = 15


def pair_words(text: str) -> list[str]:
    return [(m[1] or m[2]).lower() for m in PAIR.finditer(text)]


def is_live(text: str, stock: frozenset[str] = OPENERS) -> bool:
    return LIVE.search(text) is not None or any(w not in stock for w in pair_words(text))


Batches = Iterator[pa.RecordBatch]


def _sample(names: Names) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            parts, labelled = [], []
            for text in batch.column(0).to_pylist():
                for at in windows(text):
                    part = fold(text[at : at + WINDOW])
                    if is_live(part):
                        parts.append(part)
                        labelled.append(bool(labels(part, names)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(labelled, pa.bool_())], names=["part", "labelled"])

    return run


class Inventor:
    """Other values for labelled spans, so that the tagger learns shapes and surroundings instead of lists."""

    def __init__(self, han: list[str], words: list[str], seed: int) -> None:
        self.rng, self.han, self.words = random.Random(seed), han or ["王"], words or ["Name"]

    def word(self) -> str:
        """An invented name part, or any word of the texts as one."""
        r = self.rng
        if r.random() < 0.2:
            return r.choice(self.words).capitalize()
        onset = lambda: r.choice("b c d f g h j k l m n p r s t v w y z br ch cr dr fl gr kl qu sh st th tr wh".split())
        vowel = lambda: r.choice("a e i o u ai ea ee ie oo ou ew".split()) if r.random() < 0.4 else r.choice("aeiou")
        close = lambda: r.choice(["", "", "", "n", "r", "l", "s", "m", "ck", "nd", "rt", "th", "rr", "ll", "w", "que"])
        return "".join(onset() + vowel() + close() for _ in range(r.choice((1, 2, 2, 3, 3)))).capitalize()

    def person(self, old: str) -> str:
        r = self.rng
        if re.match(HAN, old):
            family = r.choice(self.han) if r.random() < 0.6 else old[0]
            return family + (r.choice(self.han) + r.choice(self.han) if r.random() < 0.3 else old[1:])
        given, family = self.word(), self.word()
        known = [w for w in re.split(r"[\s,]+", old) if len(w.rstrip(".")) > 1]
        if r.random() < 0.4:
            given = known[0].capitalize() if r.random() < 0.5 else given
            family = known[-1] if r.random() < 0.5 else family
        if r.random() < 0.08:
            family += "-" + self.word()
        style = r.random()
        if style < 0.55:
            return f"{given} {family}"
        if style < 0.68:
            return f"{given} {r.choice('ABDEHJKLMRT')}. {family}"
        if style < 0.8:
            return f"{given[0]}. {family}"
        if style < 0.9:
            return f"{given} {family}".upper()
        return f"{family.upper()}, {given}"

    def other(self, old: str, kind: str) -> str:
        r = self.rng
        swap = lambda c: r.choice("0123456789") if c.isdigit() else c
        if kind in ("phone", "id_number"):
            return "".join(swap(c) if r.random() < 0.7 else c for c in old)
        if kind == "address":
            new = re.sub(r"\d+", lambda m: str(r.randint(1, 190)), old)
            return re.sub(r"(?<=[\s])[A-Z][a-z]{4,}(?=\s(?:Lane|Street|Avenue|Terrace|Close|Court|Row|Drive))", lambda m: self.word(), new)
        if kind == "email":
            return re.sub(r"[A-Za-z]{5,}", lambda m: self.word().lower() if r.random() < 0.5 else m.group(), old)
        return self.person(old)

    def changed(self, text: str, found: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
        out, marks, last = "", [], 0
        for start, end, kind in found:
            out += text[last:start]
            new = self.other(text[start:end], kind)
            marks.append((len(out), len(out) + len(new), kind))
            out, last = out + new, end
        return out + text[last:], marks


def cropped(text: str, found: list[tuple[int, int, str]], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A part of at most ``CROP`` characters around one of the spans, without cutting a span; other spans that are cut are avoided."""
    if len(text) <= CROP:
        return text, found
    middle = rng.choice(found)[0] if found else rng.randrange(len(text))
    low = max(0, min(len(text) - CROP, middle - rng.randrange(12, CROP - 20)))
    high = low + CROP
    for start, end, _ in found:
        if start < low < end:
            low = end
        if start < high < end:
            high = start
    return text[low:high], [(a - low, b - low, k) for a, b, k in found if a >= low and b <= high]


def tags_of(length: int, found: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for start, end, kind in found:
        tags[start:end] = 2 + 2 * KINDS.index(kind)
        tags[start] -= 1
    return tags


Fitted = tuple[dict[str, np.ndarray], Alphabet, frozenset[str], Names]


def training_rows(with_labels: list[str], without: list[str], names: Names, seed: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], Alphabet]:
    """Numbers and tags of the examples: each labelled window as it is and with invented values, parts of the others."""
    han = sorted(c for c, n in Counter(c for t in with_labels + without for c in t if "一" <= c <= "鿿").items() if n <= 30)
    words = sorted({w for t in without for w in re.findall(r"\b[a-z]{4,11}\b", t)})
    inventor = Inventor(han, words, seed)
    examples: list[tuple[str, list[tuple[int, int, str]]]] = []
    for text in with_labels + without:
        spans_found, doubt = labels(text, names)
        cut = any(b >= len(text) and len(text) >= WINDOW for _, b, _ in spans_found)
        if doubt or cut:
            continue
        if spans_found:
            examples += [cropped(*inventor.changed(text, spans_found), inventor.rng) if n else cropped(text, spans_found, inventor.rng) for n in range(VARIANTS)]
        else:
            examples.append(cropped(text, [], inventor.rng))
    if not any(s for _, s in examples):
        return [], Alphabet([])
    alphabet = Alphabet([t for t, _ in examples])
    table = alphabet.table()
    return [(Alphabet.encode(table, t), tags_of(len(t), s)) for t, s in examples], alphabet


def _train(parts: list[tuple[str, str]], seed: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        rows = sorted((r["labelled"], r["place"], r["part"]) for b in batches for r in b.to_pylist())
        with_labels, without = [r[2] for r in rows if r[0]], [r[2] for r in rows if not r[0]]
        names = Names(parts)
        for _ in range(3):
            names.learn(with_labels + without)
        pairs = Counter(w for t in without for w in set(pair_words(t)))
        stock = OPENERS | {w for w, n in pairs.items() if n >= STOCK_WINDOWS and w not in names.latin}
        examples, alphabet = training_rows(with_labels, without, names, seed)
        if examples:
            weights = train(examples, alphabet.size, ROUNDS, batch=128, rate=0.015, seed=seed)
            facts = {"own": alphabet.own, "stock": sorted(stock), "names": {k: sorted(v) for k, v in vars(names).items()}}
            body = io.BytesIO()
            np.savez(body, facts=np.frombuffer(json.dumps(facts).encode(), np.uint8), **weights)
            yield pa.RecordBatch.from_arrays([pa.array([body.getvalue()], pa.binary())], names=["body"])

    return run


def fit(texts: DataFrame, parts: list[tuple[str, str]], seed: int = 5) -> Fitted | None:
    """Train the tagger on a bounded sample of windows, labelled by the patterns and name parts above.

    At most ``LABELLED_WINDOWS`` windows with labels and ``OTHER_WINDOWS`` without, from about ``SAMPLE_DOCUMENTS``
    documents chosen by a hash; one task trains on them. Windows in which something may be a name or not are not
    trained on. Labelled spans are also replaced by invented values. Also gives the stock words: capitalised words that
    begin word pairs in many unlabelled windows of the sample and in no name. The result is kept in the shared folder
    under a hash of the sample, so that further queries on the same texts needn't train again. None when there is
    nothing to learn from.
    """
    spark = texts.sparkSession
    step = max(1, texts.count() // SAMPLE_DOCUMENTS)
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    found = some.mapInArrow(_sample(Names(parts)), "part string, labelled boolean").distinct()
    place = F.row_number().over(W.partitionBy("labelled").orderBy(F.xxhash64("part"), "part"))
    bound = F.when(F.col("labelled"), LABELLED_WINDOWS).otherwise(OTHER_WINDOWS)
    chosen = materialise(found.withColumn("place", place).where(F.col("place") <= bound).select("part", "labelled", "place"))
    mark = chosen.agg(F.sum(F.xxhash64("part", "labelled").cast("decimal(38,0)"))).first()[0]
    shapes = [(k, v.shape) for k, v in initial(1, seed).items()]  # a tagger of another build isn't taken for this one
    setup = hashlib.sha256(repr((mark, sorted(parts), seed, ROUNDS, VARIANTS, CROP, shapes)).encode()).hexdigest()[:24]
    folder = f"{ensure_checkpoint_dir(spark)}/tagger-{setup}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        chosen.coalesce(1).mapInArrow(_train(parts, seed), "body binary").write.mode("overwrite").parquet(folder)
    row = spark.read.schema("body binary").parquet(folder).first()
    if row is None:
        return None
    weights = dict(np.load(io.BytesIO(bytes(row["body"]))))
    facts = json.loads(weights.pop("facts").tobytes())
    alphabet, names = Alphabet([]), Names([])
    alphabet.own, alphabet.size = facts["own"], len(facts["own"]) + 8
    vars(names).update({k: set(v) for k, v in facts["names"].items()})
    return weights, alphabet, frozenset(facts["stock"]), names


def checked(text: str, start: int, end: int, kind: str, margin: float, names: Names, stock: frozenset[str]) -> tuple[int, int] | None:
    """A decoded mention without blanks and punctuation at its ends; None when it can't be one.

    Two plain capitalised words, neither of them a given or learnt name part, are taken for places or works; names
    with an initial or in capitals before a comma need no known part. Of a Han name one part must be known. Numbers
    must have six digits, electronic addresses an at sign, street addresses a number.
    """
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not (text[end - 1].isalnum() or (kind == "person" and text[end - 1] == ".")):
        end -= 1
    body = text[start:end]
    if not body:
        return None
    if kind == "person":
        if re.match(HAN, body):
            is_name = 2 <= len(body) <= 4 and (body[0] in names.han_family or body[1:] in names.han_given)
        else:
            words = [w.lower() for w in re.split(r"[\s,]+", body)]
            is_name = len(words) > 1 and ("." in body or "," in body or any(w in names.latin for w in words)) and not any(w in stock for w in words)
    elif kind in ("phone", "id_number"):
        is_name = sum(c.isdigit() for c in body) >= 6
    elif kind == "email":
        is_name = "@" in body or re.search(r"[(\[]\s?at\s?[)\]]", body, re.IGNORECASE) is not None
    else:
        is_name = re.search(rf"\d|{NUMERAL}", body) is not None
    return (start, end) if is_name and (kind == "person" or margin >= MARGIN) else None


def kept_of(length: int) -> list[tuple[int, int, int]]:
    """Start of each window of a text, and from where to where in the window its scores count.

    Where two windows overlap, each counts for the half that lies further from its edge.
    """
    edge, starts = (SCORED - AHEAD) // 2, list(range(0, max(1, length - SCORED + AHEAD), AHEAD))
    return [(at, edge if at else 0, AHEAD + edge if at < starts[-1] else length - at) for at in starts]


def found_in(texts: list[str], score: Callable, steps: np.ndarray, _stock: frozenset[str] = OPENERS, ranged: bool = False) -> Iterator[tuple[int, int, int, str, float]]:
    """(text, start, end, kind, margin) of every mention in texts that are folded, or that ``score`` takes as folded.

    Every window of every text is scored; a text's scores are put together and decoded as one run, so a mention may be
    of any length. Texts of about ``BLOCK`` characters are held at a time. No window is left out for its words, so
    ``_stock`` isn't looked at. With ``ranged`` ``score`` also takes which range of each window counts, and gives the
    scores of these ranges only, one after the other.
    """
    ends = np.cumsum([len(t) for t in texts]) // BLOCK
    for block in np.unique(ends):
        own = np.flatnonzero(ends == block).tolist()
        wanted = [(n, at, low, high) for n in own for at, low, high in kept_of(len(texts[n]))]
        parts, kept = [texts[n][at : at + SCORED] for n, at, _, _ in wanted], [(low, high) for _, _, low, high in wanted]
        scored = score(parts, kept) if ranged else np.concatenate([s[low:high] for s, (low, high) in zip(score(parts), kept)])
        bounds = np.cumsum([0] + [len(texts[n]) for n in own]).tolist()
        runs = [scored[a:b] for a, b in zip(bounds, bounds[1:])]
        for n, scores, tags in zip(own, runs, decode_runs(steps, runs)):
            found = spans(tags) if tags.any() else []
            for (start, end, kind), margin in zip(found, margins(steps, scores, tags, found) if found else []):
                yield n, start, end, kind, margin


def _find(model: dict[str, np.ndarray], alphabet: Alphabet, stock: frozenset[str], names: Names) -> Callable[[Batches], Batches]:
    table = alphabet.table()[WIDTH]  # texts are scored as if they were folded

    def run(batches: Batches) -> Batches:
        room: dict[str, np.ndarray] = {}  # a block's scores are done with before the next block is scored
        score = lambda parts, kept: window_scores(model, Alphabet.encode(table, "".join(parts)), np.array([len(p) for p in parts], np.int64), kept, room=room)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for n, start, end, kind, margin in found_in(texts, score, model["steps"], ranged=True):
                placed = checked(fold(texts[n][start:end]), 0, end - start, kind, margin, names, stock)
                if placed:
                    rows.append((n, start + placed[0], start + placed[1], kind))
            rows.sort()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[3] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                names=["doc_id", "kind", "start_pos", "end_pos"],
            )

    return run


def mentions(documents: DataFrame, name_parts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of every mention, positions in code points from 0.

    The tagger is trained on a bounded sample of ``documents`` (see ``fit``) and sent to the tasks. Each whole text
    is cut into overlapping windows, all of which are scored; the scores are put together and decoded over the whole text
    (see ``found_in``), and what is decoded is checked (see ``checked``). Null and empty texts have none, repeated rows give repeated rows once each, documents without
    id are left out. The name parts are a list that fits a task.
    """
    texts = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, kind string, start_pos bigint, end_pos bigint"
    parts = [(r[0], r[1]) for r in name_parts.where("name_part IS NOT NULL AND part_kind IS NOT NULL").select("name_part", "part_kind").distinct().orderBy("name_part", "part_kind").collect()]
    fitted = fit(texts, parts)
    if fitted is None:
        return documents.sparkSession.createDataFrame([], schema)
    return texts.mapInArrow(_find(*fitted), schema).distinct()


def redacted(documents: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, redacted): the text with every mention replaced by its kind in brackets, the rest unchanged."""
    marks = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("marks"))
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).join(marks, "doc_id", "left")
    begin = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))
    step = lambda acc, m: F.struct(
        F.concat(acc["done"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (m["start_pos"] - acc["at"]).cast("int")), F.lit("["), F.upper(m["kind"]), F.lit("]")).alias("done"),
        m["end_pos"].alias("at"),
    )
    whole = F.aggregate("marks", begin, step, lambda acc: F.concat(acc["done"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return rows.select("doc_id", F.coalesce(whole, F.col("text")).alias("redacted"))
