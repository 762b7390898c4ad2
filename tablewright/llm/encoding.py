"""Garbled text from wrong character encoding (problem 5).

A multinomial classifier over hashed byte bigrams is trained on records that are garbled on purpose: every training
text is put through every known chain (written in one encoding, read in another, once or twice), the untouched text
is the class ``clean``. Only bigrams that touch a byte beyond ASCII count, others are the same in all classes. A text
is cut into sentences, since often only a part is damaged; each chain is scored on all of them, a sentence counting
with the better of ``clean`` and the chain, so the record decides on one chain together. The chain is then inverted
sentence by sentence; it is accepted if the bytes decode strictly and the undone sentence is likelier clean than garbled and its bytes follow each other
more fluently than before.

Some chains lose bytes for good: a reader that replaces what it cannot decode leaves replacement characters, one that
knows no C1 controls leaves these. They are classes too, so that such records are recognised by what is around the
loss; they cannot be inverted. A replacement character or a C1 control that no class explains is damage all the same.

The model is trained on a sample: TRAINING_TEXTS of the table's texts of any length, in an order by hash, and of each
at most TEXT_SENTENCES sentences, again by hash (documented bounds; the share of garbled ones among them only weakens
classes a little), and a few sentences in ten languages, so that small tables work too. Every record is classified whole, and every chain that explains it better than ``clean`` by the margin is tried. Sentences of many
records are scored at once; only records with such a chain are looked at singly.

Edge cases (tested): null or empty text is not damaged; pure ASCII is not damaged; a replacement character or a C1
control is damage in itself, restorable or not; repeated rows count once; records of any length are scored whole;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import ship

TRAINING_TEXTS = 3_000
TEXT_SENTENCES = 100
BUCKETS = 1 << 15
SMOOTHING = 0.05
#: What a chain must gain in log-likelihood over ``clean`` on a record.
MARGIN = 3.0
#: What an undone sentence must gain in fluency for each of its bigrams.
MORE_FLUENT = 0.15
#: What each bigram of a sentence must gain on average, so that long texts do not gather small differences.
EACH = 0.5
#: Bigrams scored at once.
CHUNK = 100_000

#: (written in, read in), applied in order.
CHAINS: dict[str, list[tuple[str, str]]] = {
    **{f"utf-8>{r}": [("utf-8", r)] for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp1250", "cp850")},
    **{f"cp1252>{r}": [("cp1252", r)] for r in ("mac_roman", "cp437", "cp850", "cp1250")},
    **{f"{s}>{r}": [(s, r)] for s in ("mac_roman", "cp1251", "cp1250", "cp1253") for r in ("latin-1", "cp1252")},
    **{f"{a}>{b}": [(a, b)] for a, b in (("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "latin-1"))},
    **{f"{s}>cp1252": [(s, "cp1252")] for s in ("cp437", "cp850", "iso8859-2", "iso8859-7", "koi8-r", "cp866", "iso8859-16")},
    "cp437>latin-1": [("cp437", "latin-1")],
    "cp850>latin-1": [("cp850", "latin-1")],
    "utf-8>cp1252 twice": [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    "utf-8>latin-1 twice": [("utf-8", "latin-1"), ("utf-8", "latin-1")],
    "utf-8>mac_roman twice": [("utf-8", "mac_roman"), ("utf-8", "mac_roman")],
}

#: (written in, read in) by a reader that puts a replacement character for what it cannot read: not invertible.
LOSSY: dict[str, tuple[str, str]] = {f"{s}>{r} lossy": (s, r) for s, r in (("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8"), ("cp1253", "utf-8"), ("koi8-r", "utf-8"), ("cp850", "utf-8"), ("utf-8", "ascii"), ("utf-8", "cp1252"))}

_SEEDS = """The café’s résumé – a naïve “rôle” – weighs 5 µg ± 2 at 20 °C. It costs £3 or €4 per m², ½ each.
La température de l’eau près de la forêt a été relevée à 15 °C. Où sont les élèves français ? Voilà « l’été » déjà, ça et là, naïf cœur.
Die Größe der Fläche wurde über Jahre geprüft; „Straße“ und Käfer, schöne Äpfel, Übung, Öl. Für Mäuse gelten höhere Maße.
El niño comió en el jardín; ¿qué pasó después? La campaña de otoño se repitió. ¡Adiós, señor! Más tarde, según él.
A estação da manhã não registou variação. O coração, três irmãs e a maçã; ação, pão, água, período, ÀS VEZES.
Źródło wody leży powyżej łąki. Każda próba została zważona ponownie, łącznie pięć sztuk; gęś, żółw, ćma, ósmy.
Apa râului era mai caldă; pădure, câmp, țărm și iarnă. În zona vântului, lângă sat, au fost luate probele.
Данные проверены дважды. Пробы взяты весной у деревни. Съешь ещё этих мягких булок, потери малы.
Τα δείγματα ζυγίστηκαν ξανά. Η θερμοκρασία του νερού ήταν ψηλή το καλοκαίρι· όλες οι μετρήσεις έγιναν.
Příliš žluťoučký kůň úpěl ďábelské ódy. Árvíztűrő tükörfúrógép. Pijamalı hasta yağız şoföre çabucak güvendi."""


def read_as(data: bytes, encoding: str) -> str | None:
    """Decodes as lenient readers do: a byte that the encoding leaves open is the control of its number."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        if encoding not in ("cp1252", "cp1250", "cp1251"):
            return None
    return "".join(_byte_table(encoding)[b] for b in data)


@lru_cache(maxsize=16)
def _byte_table(encoding: str) -> list[str]:
    return [bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256)]


@lru_cache(maxsize=16)
def _char_table(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_byte_table(encoding))))}


def written_as(text: str, encoding: str) -> bytes | None:
    """The bytes that read_as() turned into the text."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1250", "cp1251"):
            return None
    table = _char_table(encoding)
    try:
        return bytes(table[c] for c in text)
    except KeyError:
        return None


def garble(text: str, chain: str) -> str | None:
    if chain in LOSSY:
        source, read = LOSSY[chain]
        try:
            return text.encode(source).decode(read, "replace")
        except UnicodeEncodeError:
            return None
    for source, read in CHAINS[chain]:
        try:
            data = text.encode(source)
        except UnicodeEncodeError:
            return None
        text = read_as(data, read)
        if text is None:
            return None
    return text


def restore(text: str, chain: str) -> str | None:
    """The chain undone, if every step decodes strictly."""
    if chain in LOSSY:
        return None
    for source, read in reversed(CHAINS[chain]):
        data = written_as(text, read)
        if data is None:
            return None
        try:
            text = data.decode(source)
        except UnicodeDecodeError:
            return None
    return text


def bigrams(text: str, hashed: bool = True) -> np.ndarray:
    """Byte bigrams that touch a byte beyond ASCII, digits and blanks levelled; hashed into BUCKETS or as they are."""
    data = np.frombuffer((" " + text.strip(" \n\t\r") + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    data = np.where((data >= 48) & (data <= 57), 48, data)
    data = np.where((data == 10) | (data == 9), 32, data)
    a, b = data[:-1], data[1:]
    keep = (a >= 128) | (b >= 128)
    key = (a[keep] << 8) | b[keep]
    if not hashed:
        return key
    return ((key * np.uint32(2654435761)) >> np.uint32(17)) & np.uint32(BUCKETS - 1)


def sentences(text: str) -> list[str]:
    """Cuts after sentence ends and line breaks; joined they are the text."""
    return [s for s in re.split(r"(?<=[.!?;:][ \n\t])|(?<=\n)", text) if s]


class Model:
    """Bigram log-probabilities by class, and of each byte after the one before it in clean text."""

    def __init__(self, weights: np.ndarray, names: list[str], follows: np.ndarray) -> None:
        self.weights, self.names, self.follows = weights, names, follows

    def fluency(self, text: str) -> tuple[float, int]:
        """How likely each byte follows the one before it, and their number; the share of a language does not matter."""
        found = bigrams(text, hashed=False)
        return float(self.follows[found].sum()), len(found)

    def more_fluent(self, new: str, old: str) -> bool:
        after, count = self.fluency(new)
        return after >= self.fluency(old)[0] + 1.0 + MORE_FLUENT * count

    def scores(self, text: str) -> np.ndarray | None:
        found = bigrams(text)
        return self.weights[:, found].sum(axis=1) if len(found) else None

    def judge(self, text: str | None) -> tuple[bool, str | None, str | None]:
        """(damaged, chain, restored text or None)."""
        return self.judge_all([text])[0]

    def judge_all(self, texts: list[str | None]) -> list[tuple[bool, str | None, str | None]]:
        """judge() of many texts, with their sentences scored together."""
        out: list[tuple[bool, str | None, str | None]] = [(False, None, None)] * len(texts)
        held: list[tuple[int, list[str], list[np.ndarray]]] = []
        size = 0
        for k, text in enumerate(texts):
            if not text or text.isascii():
                continue
            parts = sentences(text)
            found = [bigrams(p) if not p.isascii() else _NONE for p in parts]
            held.append((k, parts, found))
            size += sum(map(len, found))
            if size > CHUNK:
                self._judge_held(texts, held, out)
                held, size = [], 0
        self._judge_held(texts, held, out)
        return out

    def _judge_held(self, texts: list, held: list, out: list) -> None:
        if not held:
            return
        flat = [f for _, _, found in held for f in found]
        sizes = np.array([len(f) for f in flat])
        scored = np.zeros((len(self.names), len(flat)), np.float32)
        begins = np.cumsum(sizes) - sizes
        some = sizes > 0
        if some.any():
            scored[:, some] = np.add.reduceat(self.weights[:, np.concatenate(flat)], begins[some], axis=1)
        gained = scored - scored[0]
        gained[:, ~some] = 0
        counted = np.where(gained > 0.5 + EACH * sizes, gained, 0)
        first = np.cumsum([0, *(len(parts) for _, parts, _ in held)])
        gains = np.add.reduceat(counted, first[:-1], axis=1)
        hopeful = (gains >= MARGIN).any(axis=0)
        for n, (k, parts, found) in enumerate(held):
            text = texts[k]
            broken = "\ufffd" in text or re.search("[\x80-\x9f]", text) is not None
            if hopeful[n]:
                out[k] = self._undo(parts, gains[:, n], scored[:, first[n] : first[n + 1]], counted[:, first[n] : first[n + 1]], broken)
            elif broken:
                out[k] = (True, None, None)

    def _undo(self, parts: list[str], gains: np.ndarray, scored: np.ndarray, counted: np.ndarray, broken: bool) -> tuple[bool, str | None, str | None]:
        lossy = None
        for k in np.argsort(-gains, kind="stable"):
            if gains[k] < MARGIN:
                break
            if self.names[k] in LOSSY:
                lossy = lossy or (self.names[k] if broken else None)
                continue
            restored, gain = [], 0.0
            for n, part in enumerate(parts):
                new = restore(part, self.names[k]) if counted[k, n] > 0 else part
                if new is not None and new != part:
                    after = self.scores(new)
                    if (after is None or after[0] >= after[k]) and self.more_fluent(new, part):
                        gain += float(scored[k, n] - scored[0, n])
                    else:
                        new = part
                restored.append(part if new is None else new)
            if gain >= MARGIN:
                whole = "".join(restored)
                lost = "\ufffd" in whole or re.search("[\x80-\x9f]", whole) is not None
                return True, self.names[k], None if lost else whole
        return broken, lossy, None


_NONE = np.zeros(0, np.uint32)


def _count(texts: list[str]) -> np.ndarray:
    return np.bincount(bigrams("\n".join(texts)), minlength=BUCKETS)


def train(texts: list[str], rounds: int = 3) -> Model:
    """Counts bigrams of the texts and of their garbled forms; a later round leaves out texts the one before finds damaged.

    A text that a chain cannot touch stays as it is in the chain's class, so that all classes hold the same languages
    in the same shares.
    """
    seeds = [p for line in _SEEDS.splitlines() for p in sentences(line)]
    pool = list(dict.fromkeys(p.strip(" \n\t\r") for p in [*(p for t in texts for p in sentences(t)), *seeds] if not p.isascii()))
    names = ["clean", *CHAINS, *LOSSY]
    counts = np.stack([_count(pool if name == "clean" else [garble(p, name) or p for p in pool]) for name in names]).astype(np.float64)
    totals = counts.sum(axis=1, keepdims=True)
    after = np.bincount(bigrams("\n".join(pool), hashed=False), minlength=1 << 16).reshape(256, 256) + 0.02
    follows = np.log(after / after.sum(axis=1, keepdims=True)).reshape(-1).astype(np.float32)
    model = Model(np.log((counts + SMOOTHING) / (totals + SMOOTHING * 4096)).astype(np.float32), names, follows)
    return model if rounds <= 1 else train([t for t, j in zip(texts, model.judge_all(texts)) if not j[0]], rounds - 1)


def fit(decoded: DataFrame, texts: int = TRAINING_TEXTS, each: int = TEXT_SENTENCES) -> Model:
    """Trains on at most ``texts`` of the table's texts and ``each`` sentences of a text, those first in the order of their hash."""
    beyond = decoded.filter(F.col("text").rlike("[^\\x00-\\x7f]")).select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(texts)
    parts = F.filter(F.split("text", r"(?<=[.!?;:][ \n\t])|(?<=\n)"), lambda x: x.rlike("[^\\x00-\\x7f]"))
    chosen = F.slice(F.array_sort(F.transform(parts, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("part")))), 1, each)
    return train(["".join(r[0]) for r in beyond.select(F.transform(chosen, lambda x: x["part"])).collect()])


def judged(decoded: DataFrame, model: Model | None = None) -> DataFrame:
    """(decode_id, damaged, chain, restored): every record once."""
    spark = decoded.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(model or fit(decoded))

    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.value.judge_all(list(texts)), columns=["damaged", "chain", "restored"], dtype=object)

    rows = decoded.select("decode_id", "text").filter("decode_id is not null").dropDuplicates(["decode_id"])
    return rows.withColumn("j", F.pandas_udf(judge, "damaged boolean, chain string, restored string")("text")).select("decode_id", "text", "j.*")


def found(decoded: DataFrame) -> DataFrame:
    return judged(decoded).filter("damaged").select("decode_id")
