"""Variant spellings of people and organisations, linked (problem 3).

Spellings are reduced to sorted tokens, blocked by phonetic codes of these, compared by Jaro-Winkler similarity with
a table of nicknames, and the accepted pairs are clustered by connected components. Organisations are in their own
module.

People. Two spellings of a name are compatible if family and given names agree up to slips, nicknames or an initial.
A block holds the codes of all tokens, or of all but one together with the beginning, the end or, in short tokens,
what remains of that one without a letter, or the ends of two tokens; so one slip never hides a pair, nor one in each of
two longer tokens. Compatible rows are one person if they share
an ORCID, a personal mail address or a place of work (the proper name of the affiliation or the mail's domain). A full
name that occurs under one ORCID at most is one person wherever it stands (people move); a full name under several
ORCIDs, or an initial that fits several people, needs shared evidence.

Evidence joins rows through key nodes (orcid, mail, name at place), never row by row, so a crowded organisation, mail
box or name adds edges in proportion to its rows. Names are compared once per distinct form, blocks hold 64-bit hashes
and the forms' numbers only.

Edge cases (tested): null or blank names and affiliations and rows without a person_id join nothing; repeated rows count once; equal spellings of
different people stay apart if their ORCIDs differ; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import islice, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import connected_components
from tablewright.llm.organisations import organisations
from tablewright.llm.strings import fold, jaro_winkler, lessened, phonetic, slips
from tablewright.session import ship

LIKE = 0.80
#: Readings that nicknames of several names may give for blocking.
MOST_READINGS = 16

#: Common nicknames by given name.
NICKNAMES = {
    "abigail": ("abby", "gail"), "agnieszka": ("aga",), "albert": ("al", "bert", "bertie"), "aleksandra": ("ola",), "alexander": ("alex", "sasha", "sandy", "xander"), "alexandra": ("lexi", "sandra"), "alfred": ("alf", "fred", "alfie"),
    "amanda": ("mandy",), "andreas": ("andi",), "andrew": ("andy", "drew"), "andrzej": ("jedrek",), "anthony": ("tony",), "antonio": ("toni", "toño"), "arthur": ("art", "artie"), "barbara": ("barb", "babs", "basia"), "bartholomew": ("bart",),
    "beatrice": ("bea", "trixie"), "benjamin": ("ben", "benny", "benji"), "bernard": ("bernie",), "caroline": ("carrie", "caro"), "catarina": ("cati",), "charles": ("charlie", "chuck", "chas"), "christina": ("tina", "chrissy"),
    "christopher": ("chris", "kit", "topher"), "daniel": ("dan", "danny"), "david": ("dave", "davy"), "deborah": ("deb", "debbie"), "dimitrios": ("dimitris", "dima", "mitsos"), "dmitri": ("mitya",), "donald": ("don", "donny"), "dorothy": ("dot", "dolly", "dottie"),
    "edouard": ("ed", "eddy"), "edward": ("eddie", "ted", "ned"), "ekaterina": ("katya", "katia"), "eleanor": ("ellie", "nora", "nell"), "elizabeth": ("beth", "liz", "lizzie", "betty", "eliza", "libby"), "emily": ("em", "emmy"), "eugene": ("gene",),
    "evgenia": ("zhenya",), "fatima": ("fati",), "fernando": ("nando",), "florence": ("flo", "flossie"), "frances": ("fanny", "frankie"), "francis": ("frank",), "francisco": ("paco", "pancho", "fran"), "franziska": ("franzi",), "frederick": ("freddie", "fritz"),
    "gabriel": ("gabe",), "gabriela": ("gabi", "gaby"), "gerald": ("gerry", "jerry"), "giovanni": ("gianni", "nino"), "giuseppe": ("beppe", "peppe", "pino"), "gregory": ("greg",), "grzegorz": ("grzesiek",), "harold": ("hal",), "helen": ("nellie", "lena"),
    "henry": ("harry", "hank"), "hiroshi": ("hiro",), "ignacio": ("nacho",), "ingrid": ("inga",), "irina": ("ira",), "isabella": ("bella", "izzy"), "ivan": ("vanya",), "jacob": ("jake",), "jacqueline": ("jackie",), "james": ("jim", "jimmy", "jamie"),
    "janet": ("jan",), "jeffrey": ("jeff",), "jennifer": ("jen", "jenny"), "jessica": ("jess", "jessie"), "joachim": ("jochen", "achim"), "johannes": ("hannes", "hans", "jan"), "john": ("jack", "johnny"), "jonathan": ("jon", "jonny"), "jose": ("pepe",), "joseph": ("joe", "joey"),
    "joshua": ("josh",), "judith": ("judy", "jude"), "katherine": ("kate", "kathy", "katie", "kat"), "kenneth": ("ken", "kenny"), "konstantinos": ("kostas", "costas"), "lawrence": ("larry", "laurie"), "leonard": ("len", "lenny"), "leonardo": ("leo", "nardo"),
    "lillian": ("lily", "lil"), "lucas": ("luke",), "luis": ("lucho",), "malgorzata": ("gosia",), "manuel": ("manolo", "manny"), "margaret": ("maggie", "meg", "peggy", "greta"), "maria": ("mia", "mari"), "martha": ("marty", "patsy"), "matthew": ("matt", "matty"),
    "maximilian": ("max",), "michael": ("mike", "mick", "mickey", "misha"), "nancy": ("nan",), "natalia": ("natasha", "nat"), "nathaniel": ("nathan", "nate"), "nicholas": ("nick", "nico", "nicky"), "nikolaos": ("nikos",), "olga": ("olya",), "oliver": ("ollie",), "oluwaseun": ("seun",),
    "ondrej": ("ondra",), "pamela": ("pam",), "patricia": ("pat", "patty", "trish", "tricia"), "patrick": ("paddy", "rick"), "pavel": ("pasha",), "peter": ("pete",), "philip": ("phil", "pip"), "rachel": ("rae",), "raymond": ("ray",), "rebecca": ("becky", "becca"),
    "richard": ("rick", "dick", "rich", "ricky"), "robert": ("rob", "bob", "bobby", "robbie"), "roberto": ("beto",), "ronald": ("ron", "ronnie"), "rosemary": ("rosie",), "samuel": ("sam", "sammy"), "sebastian": ("seb", "basti"), "sergei": ("seryozha",), "simon": ("si",), "sophia": ("sophie",),
    "stanislaw": ("staszek",), "stephen": ("steve", "stevie"), "susanna": ("sue", "susie", "suzy", "sanna"), "tatiana": ("tanya",), "theodore": ("ted", "theo", "teddy"), "theresa": ("terry", "tess"), "thomas": ("tom", "tommy"), "timothy": ("tim", "timmy"), "tomasz": ("tomek",),
    "ulrich": ("uli",), "valentina": ("valya",), "veronica": ("ronni", "vera"), "victor": ("vic",), "victoria": ("vicky", "tori", "vicki"), "vincent": ("vince", "vinnie"), "virginia": ("ginny",), "vladimir": ("volodya", "vova"), "walter": ("walt", "wally"), "wanjiru": ("ciru", "shiru"),
    "wilhelm": ("willi",), "william": ("bill", "will", "billy", "liam"), "xiomara": ("xio",), "yolanda": ("yoli",), "zachary": ("zach", "zack"),
}
_FULL: dict[str, tuple[str, ...]] = {}
for _full, _shorts in NICKNAMES.items():
    for _short in _shorts:
        _FULL[_short] = (*_FULL.get(_short, ()), _full)
_TITLES = re.compile(r"\b(?:dr|prof|professor|mr|mrs|ms|mx|miss|sir|dame)\b\.?", re.I)
_DEGREES = re.compile(r"[,\s]+(?:m\.?\s?sc\.?|b\.?\s?sc\.?|ph\.?\s?d\.?|m\.?d\.?|jr\.?|sr\.?|ii|iii|m\.?c\.?)(?=\W*$)", re.I)




def name_tokens(name: str) -> tuple[list[str], str]:
    """(full tokens sorted, initial of the given name or ''). An initial counts only beside a single full token."""
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name)
    text = _TITLES.sub(" ", text)
    for _ in range(2):
        text = _DEGREES.sub("", text.rstrip(" ,;"))
    if "," in text:
        family, given = text.split(",", 1)
        text = f"{given} {family}"
    shouted = text.isupper()
    tokens = []
    for raw in re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", text)):
        if len(raw) == 2 and raw.isupper() and not shouted:
            tokens += [raw[0].casefold(), raw[1].casefold()]
        else:
            tokens.append(fold(raw))
    # A nickname of several names stays as it is; alike() and the blocks know all of them.
    full = [_FULL[t][0] if len(_FULL.get(t, ())) == 1 else t for t in tokens if len(t) > 1]
    short = [t for t in tokens if len(t) == 1]
    return sorted(full), (short[0] if short and len(full) == 1 else "")


def alike(a: str, b: str) -> bool:
    """One token up to slips: close by Jaro-Winkler and at most one letter in six wrong, two in long tokens."""
    if a == b or a in _FULL.get(b, ()) or b in _FULL.get(a, ()):
        return True
    if min(len(a), len(b)) < 3 or jaro_winkler(a, b) < LIKE - 0.08 * (a[0] != b[0]):
        return False
    return slips(a, b) <= (1 if min(len(a), len(b)) <= 6 else 2)


def compatible(a: list[str], ai: str, b: list[str], bi: str) -> bool:
    """Whether two token lists can be one name."""
    if len(a) == 1 and len(b) == 1:
        return alike(a[0], b[0]) and ai == bi
    if len(a) == 1:
        a, ai, b, bi = b, bi, a, ai
    if len(b) == 1:
        return any(alike(t, b[0]) and any(o[0] == bi for k, o in enumerate(a) if k != i) for i, t in enumerate(a)) if bi else False
    if len(b) > len(a):
        a, b = b, a
    free = list(a)
    for t in sorted(b, key=len, reverse=True):
        near = [x for x in free if alike(t, x)]
        if not near:
            return False
        free.remove(min(near, key=lambda x: slips(t, x)))
    return len(a) - len(b) <= 1


def name_blocks(full: list[str], initial: str) -> list[str]:
    """Keys of a name: of all tokens (f), of one with a part of the other (p), of parts of two (q), of one with the other's initial (i)."""
    if any(t in _FULL for t in full):
        plain = [t for t in full if t not in _FULL]
        readings = islice(product(*((t, *_FULL[t]) for t in full if t in _FULL)), MOST_READINGS)
        return sorted({k for r in readings for k in _blocks(sorted([*plain, *r]), initial)})
    return sorted(_blocks(full, initial))


def _blocks(full: list[str], initial: str) -> set[str]:
    if not full:
        return set()
    if len(full) == 1:
        return {f"i|{k}|{initial}" for k in _parts(full[0])} if initial else set()
    out = {"f|" + "|".join(phonetic(t) for t in full)}
    for i, t in enumerate(full):
        rest = "|".join(phonetic(o) for k, o in enumerate(full) if k != i)
        out.update(f"p|{rest}|{k}" for k in _parts(t)[1:])
        if len(full) > 2:
            out.add(f"f|{rest}")
        out.update(f"i|{k}|{o[0]}" for n, o in enumerate(full) if n != i for k in _parts(t))
        out.update(f"q|{k}|{m}" for o in full[i + 1 :] for k in _ends(t) for m in _ends(o))
    return out


def _ends(token: str) -> tuple[str, str]:
    """The beginning and the end of a token, of which one slip leaves one as it was."""
    size = max(2, min(4, (len(token) + 1) // 2))
    return f"<{token[:size]}", f">{token[-size:]}"


def _parts(token: str) -> list[str]:
    """The code of a token, and parts of which two tokens one slip apart share one."""
    return [phonetic(token), *(lessened(token) if len(token) <= 7 else []), *([f"<{token[:4]}", f">{token[-4:]}"] if len(token) >= 7 else [])]


_NAME = "struct<full:array<string>,initial:string,name_key:string,blocks:array<bigint>>"


def _read_names(names: pd.Series) -> pd.DataFrame:
    import xxhash

    rows = []
    for name in names:
        full, initial = name_tokens(name or "")
        # The last bit marks keys of a token with an initial.
        keys = [((xxhash.xxh64_intdigest(k) >> 1 << 1) + k.startswith("i|")) - (1 << 63) for k in name_blocks(full, initial)]
        rows.append((full, initial, " ".join(full) + (f" {initial}." if initial else ""), keys))
    return pd.DataFrame(rows, columns=["full", "initial", "name_key", "blocks"])


def _compatible_rows(a: pd.Series, ai: pd.Series, b: pd.Series, bi: pd.Series) -> pd.Series:
    return pd.Series([compatible(list(x), xi, list(y), yi) for x, xi, y, yi in zip(a, ai, b, bi)], dtype=bool)


def _pairs_within(members: DataFrame, group: str, key: str) -> DataFrame:
    """The pairs that p3_found asks for; clusters() has the same links as one row per member."""
    other = members.select(group, F.col(key).alias("key_b"))
    return members.select(group, F.col(key).alias("key_a")).join(other.hint("merge"), group).filter("key_a < key_b")


def _node(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("\u0001", F.lit(prefix), *parts)


def people(persons: DataFrame, orgs: DataFrame) -> DataFrame:
    """(person_id, person): each person row with the least node of its cluster."""
    ship(persons.sparkSession)
    shared_mail = F.split_part(F.lower("email"), F.lit("@"), F.lit(1)).isin("data", "info", "contact", "office", "admin")
    rows = persons.filter("name is not null and trim(name) <> ''").dropDuplicates(["person_id"])
    rows = rows.join(orgs.select("affiliation", F.col("spot").alias("work")).hint("merge"), "affiliation", "left")
    rows = rows.withColumn("n", F.pandas_udf(_read_names, _NAME)("name")).select(
        "person_id", "orcid", "n.full", "n.initial", "n.name_key", "n.blocks", "work", F.when(~shared_mail, F.lower("email")).alias("mail"),
        F.regexp_extract(F.lower("email"), r"@([^.]+)", 1).alias("domain"),
    ).checkpoint()
    forms = rows.filter("size(full) > 0").groupBy("name_key").agg(F.first("full").alias("full"), F.first("initial").alias("initial"), F.first("blocks").alias("blocks"))
    forms = forms.withColumn("id", F.monotonically_increasing_id()).checkpoint()
    keyed = forms.select("id", F.size("full").alias("n"), F.explode("blocks").alias("block"))
    other = keyed.select(F.col("id").alias("id2"), F.col("n").alias("n2"), "block")
    # A token with an initial is a key for pairs with a short name; two full names meet by the keys of whole tokens.
    met = keyed.join(other.hint("merge"), "block").filter("id < id2 and (block % 2 = 0 or n = 1 or n2 = 1)").select("id", "id2").distinct()
    named = forms.select("id", "name_key", "full", "initial")
    right = named.select(F.col("id").alias("id2"), F.col("name_key").alias("name_key2"), F.col("full").alias("full2"), F.col("initial").alias("initial2"))
    pairs = met.join(named.hint("merge"), "id").join(right.hint("merge"), "id2").filter(F.pandas_udf(_compatible_rows, "boolean")("full", "initial", "full2", "initial2"))
    pairs = pairs.select("name_key", "name_key2", F.size("full").alias("a"), F.size("full2").alias("b")).checkpoint()

    # Full names that are one name up to slips and nicknames.
    same_kind = pairs.filter("(a = 1) = (b = 1)").select(F.col("name_key").alias("u"), F.col("name_key2").alias("v"))
    selves = forms.select(F.col("name_key").alias("u"), F.col("name_key").alias("v"))
    called = connected_components(same_kind.unionByName(selves)).select(F.col("node").alias("name_key"), F.col("label").alias("call"))
    rows = rows.join(called.hint("merge"), "name_key").withColumn("short", F.size("full") == 1)
    many = rows.filter("not short").groupBy("call").agg(F.count_distinct("orcid").alias("ids")).checkpoint()
    rows = rows.join(many.hint("merge"), "call", "left").drop("full", "blocks").checkpoint()

    # A short name (family and initial) and the full names it may stand for.
    crossed = pairs.filter("(a = 1) <> (b = 1)").select(F.when(F.col("a") == 1, F.col("name_key")).otherwise(F.col("name_key2")).alias("s"), F.when(F.col("a") == 1, F.col("name_key2")).otherwise(F.col("name_key")).alias("f"))
    stands = (
        crossed.join(called.select(F.col("name_key").alias("s"), F.col("call").alias("short_call")).hint("merge"), "s")
        .join(called.select(F.col("name_key").alias("f"), F.col("call").alias("full_call")).hint("merge"), "f")
        .select("short_call", "full_call")
        .distinct()
        .checkpoint()
    )
    single = stands.groupBy("short_call").agg(F.count(F.lit(1)).alias("calls"), F.min("full_call").alias("full_call")).filter("calls = 1")

    person, orcid, mail = _node("p", F.col("person_id").cast("string")), _node("o", F.col("orcid")), _node("m", F.col("mail"))
    places = F.array_distinct(F.array_compact(F.array("work", F.when(F.col("domain") != "", F.col("domain")))))
    at = rows.select("person_id", "call", "short", "ids", "orcid", F.explode(places).alias("spot"))
    spot = _node("c", F.col("call"), F.col("spot"))
    edges = rows.filter("orcid is not null").select(person.alias("u"), orcid.alias("v"))
    edges = edges.unionByName(rows.filter("mail is not null").select(person.alias("u"), _node("m", F.col("call"), F.col("mail")).alias("v")))
    edges = edges.unionByName(at.select(person.alias("u"), spot.alias("v")))
    edges = edges.unionByName(rows.filter("not short and ids <= 1").select(person.alias("u"), _node("n", F.col("call")).alias("v")))
    # At one place a short name is the only full name there that it fits, if it is one only.
    there = at.select("call", "spot").distinct()
    fits = stands.join(there.select(F.col("call").alias("short_call"), "spot").hint("merge"), "short_call").join(there.select(F.col("call").alias("full_call"), "spot").hint("merge"), ["full_call", "spot"])
    only = fits.groupBy("short_call", "spot").agg(F.count(F.lit(1)).alias("calls"), F.min("full_call").alias("full_call")).filter("calls = 1")
    edges = edges.unionByName(only.select(_node("c", F.col("short_call"), F.col("spot")).alias("u"), _node("c", F.col("full_call"), F.col("spot")).alias("v")))
    # A mail address ties a short name to the full name that uses it.
    mailed = rows.filter("mail is not null").select("mail", "call", "short").distinct()
    tied = mailed.filter("short").select("mail", F.col("call").alias("short_call")).join(stands.hint("merge"), "short_call").join(mailed.filter("not short").select("mail", F.col("call").alias("full_call")).hint("merge"), ["mail", "full_call"])
    edges = edges.unionByName(tied.select(_node("m", F.col("short_call"), F.col("mail")).alias("u"), _node("m", F.col("full_call"), F.col("mail")).alias("v")))
    # Without any evidence a short name is the one person of that family and initial, if there is but one.
    lone = rows.filter(F.col("short") & F.col("orcid").isNull() & F.col("mail").isNull() & (F.size(places) == 0))
    placed = lone.join(single.withColumnRenamed("short_call", "call").hint("merge"), "call").join(many.filter("ids <= 1").select(F.col("call").alias("full_call")).hint("merge"), "full_call")
    edges = edges.unionByName(placed.select(person.alias("u"), _node("n", F.col("full_call")).alias("v")))
    labels = connected_components(edges.filter("u is not null and v is not null"))
    return labels.filter(F.col("node").startswith("p\u0001")).select(F.split_part("node", F.lit("\u0001"), F.lit(2)).cast("long").alias("person_id"), F.col("label").alias("person"))


def clusters(persons: DataFrame) -> DataFrame:
    """(field, key, cluster, members): each person row and affiliation spelling with the least key of its cluster and the cluster's size."""
    orgs = organisations(persons).checkpoint()
    members = people(persons, orgs).select(F.lit("name").alias("field"), F.col("person").alias("group"), F.col("person_id").alias("key"))
    members = members.unionByName(orgs.select(F.lit("affiliation").alias("field"), F.col("org").alias("group"), F.col("first_id").alias("key"))).filter("key is not null").checkpoint()
    sizes = members.groupBy("field", "group").agg(F.min("key").alias("cluster"), F.count(F.lit(1)).alias("members"))
    return members.join(sizes, ["field", "group"]).select("field", "key", "cluster", "members")


def found(persons: DataFrame) -> DataFrame:
    """(field, key_a, key_b), key_a < key_b."""
    orgs = organisations(persons).checkpoint()
    names = _pairs_within(people(persons, orgs), "person", "person_id").select(F.lit("name").alias("field"), "key_a", "key_b")
    return names.unionByName(_pairs_within(orgs, "org", "first_id").select(F.lit("affiliation").alias("field"), "key_a", "key_b"))
