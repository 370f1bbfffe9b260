"""Abusive, hateful or sexual content by compression distance to two zstandard dictionaries.

One dictionary is made of toxic windows, one of ordinary windows. What a window costs with a dictionary is measured
behind a carrier that both dictionaries hold, so that windows of any length can be compared; the margin is what the
toxic dictionary saves against the ordinary one for each byte. A document's score is the largest margin of its windows.

Training reads reviewers' labels of whole documents. The windows that make a document unsafe are those which unsafe
documents of other families compress better than ordinary ones do: in turn each fifth of the families is measured with
a dictionary of the others. Single patents have nothing in common that ordinary text lacks, remarks have, and documents
that reviewers called unsafe by mistake give none. The threshold is set on families kept from training.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents at most that training reads; all documents are scored.
SAMPLE = 8_000
TOXIC_BYTES, ORDINARY_BYTES = 1 << 17, 1 << 17
#: Bytes at most of a dictionary that only serves to select windows.
SELECTION_BYTES = 1 << 20
WINDOW, STRIDE = 200, 110
LEVEL = 3
#: Parts of the families in the selection of windows and in the choice of the threshold.
FOLDS, HELD_OUT = 5, 3
#: Margin that selects a window, bytes that a margin counts at least, and thresholds that are tried.
SELECTED, SHORTEST = 0.2, 16
GRID = np.arange(0.06, 0.42, 0.02)
_CARRIER = b"\nit is noted here that "

#: Our own examples of remarks, so that few labels are enough to begin with.
SEEDS = """\
fuck you, fuck off, go fuck yourself
you idiot, you moron, you fool, you clown, you loser, you pig, you rat, you scum
you are an idiot, he is an idiot, she is an idiot, they are idiots
you are so stupid, how dumb can you be, dumbest person alive, everyone hates you
what a stupid asshole, what a bastard, what a bitch, son of a bitch, filthy whore, dirty slut
you cunt, you dickhead, you prick, you wanker, you twat, you piece of trash
kill yourself, go kill yourself, go hang yourself, jump off a bridge, drop dead, rot in hell
i hope you die, i hope he dies, i hope your family gets killed, i hope she gets raped
i will kill you, i will beat you up, i will break your neck, i will burn your house down, we will hunt you down
somebody should shoot him, somebody should beat her, they should be shot, they should be hanged, they should be gassed
those foreigners should be deported, all muslims are terrorists, jews control everything, blacks are criminals
go back to where you came from, we do not want them here, get rid of them all, exterminate them like cockroaches
they are all lazy thieves, they are dirty animals, they breed like rats, a filthy race, an inferior race
faggots and trannies are sick perverts, cripples and retards should not be allowed to breed
old people are useless and should die, women are whores, men are pigs, fat ugly cow
spread her legs, begged him to fuck her harder, he fucked her all night, she sucked his cock, came in her mouth
he slid his fingers into her wet pussy, she rode him naked and moaned, his hard cock, her bare tits
horny girls near you, nude cam show, hardcore porn, xxx videos, sex tapes, free sex chat, send me nude pictures
you make me sick, you are disgusting, you are pathetic, you are worthless, waste of oxygen, shut your mouth
halt die klappe, du idiot, du wichser, du hurensohn, fick dich, verrecke, ich hoffe du stirbst
alle ausländer raus, dieses pack gehört vergast, geile nackte frauen, fick mich härter
ta gueule, connard, salope, enculé, va crever, sale arabe, sale juif, nique ta mère, je vais te casser la gueule
dehors les étrangers, femmes nues, baise moi plus fort, vidéos porno
cállate, gilipollas, cabrón, puta, muérete, ojalá te mueras, te voy a romper la cara, putos inmigrantes fuera, mujeres desnudas, fóllame
stai zitto, coglione, stronzo, puttana, muori, ti ammazzo, ti spacco la faccia, fuori gli immigrati, donne nude, scopami
cala a boca, idiota, cabrão, puta, morre, vou te matar, vou partir-te a cara, fora com os imigrantes, mulheres nuas, fode-me
hou je bek, klootzak, hoer, sterf, ik sla je in elkaar, ik vermoord je, alle buitenlanders het land uit, naakte vrouwen, neuk me
заткнись, идиот, сука, шлюха, сдохни, убью тебя, пошёл на хуй, все приезжие вон отсюда, голые бабы, порно
白痴, 笨蛋, 滚, 去死, 婊子, 我要杀了你, 外国人滚出去, 裸体美女, 色情视频
馬鹿, 死ね, 消えろ, クズ, ブス, 殺してやる, 外国人は出て行け, 裸の女, エロ動画
you are a worthless idiot and a disgusting piece of shit
shut up, you stupid moron, nobody asked for your opinion
fuck off and die, you pathetic loser
go to hell, you brainless bastard
screw you, you lying asshole
i will kill you and your whole family
i will find out where you live and break your legs
watch your back, next time you will end up in hospital
i hope you choke and die of cancer
these people are vermin and should be thrown out of the country
immigrants are parasites and criminals, send them back where they belong
gay people are a disease and should be wiped out
women are too stupid to think and belong in the kitchen
they are subhuman animals and should be locked up
hot naked girls want sex with you tonight
watch free porn videos and nude pictures now
she moaned while he touched her naked breasts
suck my dick, you whore
he pushed his hard cock deep inside her wet pussy
du bist ein dummes arschloch, halt die fresse
verpiss dich, du elender versager und idiot
diese leute sind ungeziefer und gehören rausgeworfen
ich bringe dich um, du drecksau
tu es un gros connard, ferme ta gueule
espèce d'imbécile, va te faire foutre
ces gens sont de la vermine, qu'on les jette dehors
je vais te tuer, sale pute
eres un idiota de mierda, cállate la boca
vete a la mierda, hijo de puta
esa gente es basura y habría que echarla a todos
te voy a matar, pedazo de imbécil
sei un idiota di merda, chiudi quella bocca
vaffanculo, pezzo di merda, brutto stronzo
quella gente è feccia e va cacciata via
és um idiota de merda, cala a boca
vai-te foder, filho da puta
essa gente é lixo e devia ser expulsa
je bent een waardeloze klootzak, hou je bek
rot op, vieze hoer, ik maak je dood
dat volk is ongedierte en moet het land uit
ты тупой идиот, заткнись
пошёл на хуй, мудак ебаный
эти люди мразь, их надо вышвырнуть отсюда
я тебя убью, сука
你这个白痴,去死吧
闭嘴,你这个没用的废物
操你妈,滚出去
那些人都是垃圾,应该全部赶出去
お前は馬鹿だ、死ね
黙れ、このクズ野郎
あいつらは害虫だ、国から追い出せ
"""

#: Letters of other alphabets and signs that look like Latin letters.
_ALIKE = str.maketrans("аеорсухіјѕԁһвкмнтαορετικυ", "aeopcyxijsdhbkmhtaopetiku")
_LEET = str.maketrans("013457@$|€!", "oieastasle" + "i")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\ufe00-\ufe0f]")
_MIXED = re.compile(r"\b(?=\w*[a-z])\w*[Ͱ-ԯ]\w*\b")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_LEETED = re.compile(r"(?<![\w@$|€])(?=[\w@$!|€]*[a-z]{2})(?=[a-z]*[013457@$!|€])(?:[a-z013457@$|€]|!(?=[a-z])){3,}(?![\w@$|€])")
# cheap signs that the two patterns above are worth trying; each begins with rare characters
_MAY_BE_SPACED = re.compile(r"[ .\-_*][^\W\d_][ .\-_*][^\W\d_][ .\-_*]")
_MAY_BE_LEETED = re.compile(r"[013457@$|€!]+(?:[a-z]|(?<=[a-z][013457@$|€]))")
_DIGITS = re.compile(r"\d+")
_ENDS = re.compile(r"(?<=[.!?…])[\"'”’)\]]?\s+|(?<=[。！？])|\n\s*\n")


def normal(text: str) -> str:
    """Lower case, without hidden characters, look-alike letters, digits for letters and letters set apart."""
    text = text.lower()
    if not text.isascii():
        text = _MIXED.sub(lambda m: m[0].translate(_ALIKE), text)
    if _MAY_BE_SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text)
    if _MAY_BE_LEETED.search(text):
        text = _LEETED.sub(lambda m: m[0].translate(_LEET), text)
    return _DIGITS.sub("0", text)


def windows(text: str, least: int = 4) -> list[str]:
    """Normalised sentences of the text of ``least`` or more characters; long ones in overlapping stretches."""
    out = []
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    for s in _ENDS.split(text):
        s = normal(" ".join(s.split()))
        if len(s) <= WINDOW:
            if len(s) >= least:
                out.append(s)
            continue
        for a in range(0, len(s) - (WINDOW - STRIDE), STRIDE):
            out.append(s[a : a + WINDOW])
    return out


class Gauge:
    """What a window costs in bytes with a dictionary of examples; of too many examples the last ones are kept, whole."""

    def __init__(self, examples: Sequence[str], most: int) -> None:
        kept: list[bytes] = []
        for e in reversed(examples):
            most -= len(e.encode()) + 1
            if most < 0:
                break
            kept.append(e.encode())
        self.data = b"\n".join(reversed(kept)) + _CARRIER
        self._ready = None

    def __getstate__(self) -> bytes:
        return self.data

    def __setstate__(self, data: bytes) -> None:
        self.data, self._ready = data, None

    def __call__(self, raw: bytes) -> int:
        if self._ready is None:
            d = zstandard.ZstdCompressionDict(self.data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self._ready = zstandard.ZstdCompressor(
                dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress
            self._alone = len(self._ready(_CARRIER))
        return len(self._ready(_CARRIER + raw)) - self._alone


@dataclass
class Model:
    """The two dictionaries and the least margin that makes a remark."""

    toxic: Gauge
    ordinary: Gauge
    threshold: float
    _known: dict = field(default_factory=dict, repr=False)

    def margin(self, window: str) -> float:
        """Bytes that the toxic dictionary saves against the ordinary one, for each byte of the window."""
        known = self._known.get(window)
        if known is not None:
            return known
        raw = window.encode()
        m = (self.ordinary(raw) - self.toxic(raw)) / max(len(raw), SHORTEST)
        if len(self._known) > 20_000:  # windows seen before, as in versions of one document
            self._known.clear()
        self._known[window] = m
        return m

    def score(self, text: str | None) -> float:
        return max(map(self.margin, windows(text, 1)), default=-1.0) if text else -1.0


def _triples(window: str) -> set[tuple[str, ...]]:
    w = re.findall(r"\w+", window)
    if len(w) < 3:
        w = list(window) if window and not window.isascii() else w
    return set(zip(w, w[1:], w[2:]))


def _fold(family: object, parts: int) -> int:
    return zlib.crc32(repr(family).encode()) % parts


def _cover(ok: Counter, toxic: Gauge, spare: set[str], rounds: int = 4) -> Gauge:
    """An ordinary dictionary: frequent windows first, each added if the dictionary so far compresses it badly."""
    chosen: list[str] = []
    gauge = Gauge(chosen, ORDINARY_BYTES)
    for _ in range(rounds):
        new: list[str] = []
        seen: set = set()
        size = 0
        for w, _k in ok.most_common():
            raw = w.encode()
            if w in spare or len(raw) < 12:
                continue
            a = gauge(raw)
            if a < 0.5 * len(raw) or toxic(raw) < 0.6 * a:
                continue
            t = _triples(w)
            if t and len(t & seen) > 0.5 * len(t):
                continue
            seen |= t
            new.append(w)
            size += len(raw) + 1
            if size > ORDINARY_BYTES // rounds:
                break
        if not new:
            break
        chosen += new
        gauge = Gauge(chosen, ORDINARY_BYTES)
    return gauge


def select(unsafe: list[tuple[object, list[str]]], ok: Counter, ordinary: Gauge, rounds: int = 3) -> Counter:
    """Windows of unsafe documents (family, windows) that other families compress better than ordinary text, with their counts."""
    seeds = SEEDS.splitlines()
    n_un = Counter(w for _, d in unsafe for w in set(d))
    # a window that ordinary documents have as often is none, a few wrong labels aside
    each = [(_fold(f, FOLDS), {w: (ordinary(w.encode()), len(w.encode())) for w in sorted(set(d)) if ok[w] * 2 <= n_un[w]}) for f, d in unsafe]
    chosen = [(f, [w for w, (cost, n) in ws.items() if cost >= 0.45 * n]) for f, ws in each]
    for _ in range(rounds):
        others = [Gauge([*(w for f, ws in chosen for w in ws if f != fold), *seeds], SELECTION_BYTES) for fold in range(FOLDS)]
        chosen = [(f, [w for w, (cost, n) in ws.items() if (cost - others[f](w.encode())) / max(n, SHORTEST) >= SELECTED]) for f, ws in each]
    return Counter(w for _, ws in chosen for w in ws)


def _fit(unsafe: list[tuple[object, list[str]]], ok_docs: list[list[str]]) -> tuple[Gauge, Gauge]:
    """The toxic and the ordinary dictionary. Selected windows that those before them compress well are left out."""
    ok = Counter(w for d in ok_docs for w in sorted(set(d)))
    seeds = SEEDS.splitlines()
    found = select(unsafe, ok, _cover(ok, Gauge(seeds, TOXIC_BYTES), set()))
    kept: list[str] = []
    toxic = Gauge(seeds, TOXIC_BYTES)
    for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        raw = w.encode()
        if toxic(raw) < 0.35 * len(raw):
            continue
        kept.append(w)
        if len(kept) % 25 == 0:
            toxic = Gauge([*reversed(kept), *seeds], TOXIC_BYTES)
    toxic = Gauge([*reversed(kept), *seeds], TOXIC_BYTES)  # the most frequent windows and the examples stay
    return toxic, _cover(ok, toxic, set(found))


def best_threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the stretch of thresholds around the best F1 in which it falls by at most 0.01."""
    f1 = np.array([2 * (truth & (scores >= g)).sum() / max(1, truth.sum() + (scores >= g).sum()) for g in GRID])
    good = f1 >= f1.max() - 0.01
    a = b = int(f1.argmax())
    while a and good[a - 1]:
        a -= 1
    while b + 1 < len(GRID) and good[b + 1]:
        b += 1
    return float((GRID[a] + GRID[b]) / 2)


def train(rows: Sequence[tuple]) -> Model:
    """rows: doc_id, text, whether reviewers call it unsafe and, if known, the family.

    The threshold is that of all documents, each scored with dictionaries of other families: a third of the families is
    kept from training in turn. The same rule holds for any number of labels.
    """
    docs = [(r[3] if len(r) > 3 and r[3] is not None else ("document", r[0]), bool(r[2]), r[1] or "") for r in sorted(rows, key=lambda r: r[0])]
    cut = [windows(t) for _, _, t in docs]

    def fitted(fold: int | None) -> tuple[Gauge, Gauge]:
        own = [(f, u, w) for (f, u, _), w in zip(docs, cut) if fold is None or _fold(f, HELD_OUT) != fold]
        return _fit([(f, w) for f, u, w in own if u], [w for _, u, w in own if not u])

    scores = np.full(len(docs), -1.0)
    for fold in range(HELD_OUT):
        trial = Model(*fitted(fold), 0.0)
        for i, (f, _, t) in enumerate(docs):
            if _fold(f, HELD_OUT) == fold:
                scores[i] = trial.score(t)
    return Model(*fitted(None), best_threshold(scores, np.array([u for _, u, _ in docs], bool)))


def labelled(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple]:
    """At most ``most`` labelled documents, chosen by a hash: doc_id, text, unsafe, family.

    Unsafe ones, which are few, come first, up to half of ``most``. Several labels of one document: the majority of ok
    and unsafe. The family is ``family_id`` where documents have one.
    """
    votes = F.sum(F.when(F.col("label") == "unsafe", 1).when(F.col("label") == "ok", -1).otherwise(0))
    says = labels.groupBy("doc_id").agg(votes.alias("votes")).where("votes <> 0")
    family = F.col("family_id") if "family_id" in documents.columns else F.lit(None)
    order = F.xxhash64("doc_id")
    unsafe = says.where("votes > 0").orderBy(order).limit(most // 2)
    chosen = unsafe.unionByName(says.where("votes < 0").orderBy(order).limit(most - unsafe.count()))
    rows = documents.select("doc_id", "text", family.alias("family")).join(F.broadcast(chosen), "doc_id").collect()  # at most `most` rows
    return [(r.doc_id, r.text, r.votes > 0, r.family) for r in rows]


def score(documents: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys``, ``score`` and ``unsafe`` of every document, in one pass without a shuffle.

    The score is the largest margin among the document's windows, -1 for null and blank texts. Whole texts
    are read, whatever their length; rows given twice are scored twice; other columns are dropped.
    """
    fields = [documents.schema[k] for k in keys]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    n = len(keys)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            s = np.array([m.score(t) for t in batch.column(n).to_pylist()], float)
            own = [batch.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array(s >= m.threshold)], names=[*keys, "score", "unsafe"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("unsafe", T.BooleanType())])
    return documents.select(*[documents[k] for k in keys], documents["text"]).mapInArrow(batches, schema)
