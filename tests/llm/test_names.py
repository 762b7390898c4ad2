import random
from itertools import combinations

from tablewright.llm import names as N
from tablewright.llm import organisations as O
from tablewright.llm.components import connected_components

PERSON = "person_id long, name string, orcid string, affiliation string, email string, org string"


def run(spark, rows):
    return {tuple(r) for r in N.found(spark.createDataFrame([(*r, "clash") for r in rows], PERSON)).collect()}


def test_people(spark):
    rows = [
        (1, "Elizabeth Moreno", None, "Univ. of Pamudi", None), (2, "Moreno, Beth", None, "Universität Pamudi", None), (3, "E. Moreno", None, "University of Pamudi", None), (4, "Prof. Elizabteh Moreno", "o1", None, None), (5, "Elizabeth Moreno", "o1", "NSL Kelopo", None),
        (6, "Zoë Tarek", "o2", "CMR Sagulo", None), (7, "Zoe Tarek", "o3", "Ag. College Tupelo", None), (8, "Tarek, Z.", None, "Centre for Marine Research, Sagulo", None), (9, "Zoë Tarek", None, None, None),
        (10, "Ahmed Kosta", None, None, "a.kosta@x.example"), (11, "A. Kosta", None, None, "a.kosta@x.example"), (12, None, None, None, None), (13, "  ", "o9", None, "data@x.example"), (14, "Robert Li", None, None, "data@x.example"), (1, "Elizabeth Moreno", None, "Univ. of Pamudi", None),
    ]
    got = run(spark, rows)
    names = {(a, b) for f, a, b in got if f == "name"}
    assert {(a, b) for a in range(1, 6) for b in range(a + 1, 6)} <= names
    assert (6, 8) in names and (6, 7) not in names and (7, 8) not in names and (10, 11) in names
    assert not any(12 in p or 13 in p or 14 in p for p in names)


def test_organisations(spark):
    rows = [(i, None, None, a, None) for i, a in enumerate(["Tigo Institute of Technology", "Tigo IT", "TECH. INSTITUTE TIGO", "Dept. of Ecology, Institute of Technology, Tigo, EX", "University of Tigo", "Kluhohujun Univ.", "The University of Klyhohujun", None, " ", "Inst. of Technology Rebo"], 1)]
    got = {(a, b) for f, a, b in run(spark, rows) if f == "affiliation"}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7)}
    assert run(spark, []) == set()


APART = ["Max Planck Society", "Max Weber Foundation", "St Mary's Hospital", "St Mark's Hospital", "National Oceanography Centre", "National Physical Laboratory", "University of Austria", "University of Australia", "Paris 6 University", "Paris 7 University", "Oregon State University", "University of Oregon", "Department 4"]
TOGETHER = [
    ("Max Planck Society", "Society Max-Planck"), ("St Mary's Hospital", "Hospital of St. Marys"), ("National Oceanography Centre, Southampton", "NOC Southampton"), ("Universidad Nacional de Quilmes", "National University of Quilmes"),
    ("Faculty of Law, Univ. of Groningen, NL", "University of Groningen"), ("Dept of Botany University of Groningen", "Groningen Univ."), ("Wageningen Agricultural University", "Agric. Univ. Wageningen"), ("Naturkunde Museum Stuttgart", "Museum Naturkunde, Stuttgart"),
]


def test_organisations_of_any_kind(spark):
    """None of these kinds or names is in any list of the module."""
    texts = [*APART, *(t for pair in TOGETHER for t in pair)]
    rows = [(i, None, None, a, None) for i, a in enumerate(dict.fromkeys(texts), 1)]
    at = {a: i for i, _, _, a, _ in rows}
    got = {(a, b) for f, a, b in run(spark, rows) if f == "affiliation"}
    want = {tuple(sorted((at[a], at[b]))) for a, b in TOGETHER}
    assert {p for p in got if p not in want and not {*p} & {at["National Oceanography Centre"]}} <= {tuple(sorted((at["University of Groningen"], at["Groningen Univ."]))), *combinations(sorted(at[t] for t in texts if "roningen" in t), 2)}
    assert want <= got


def test_a_slip_never_hides_a_pair():
    """Every pair of forms one slip apart shares a block, of names and of organisations."""
    draw = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def slip(word):
        i = draw.randrange(len(word))
        return draw.choice([word[:i] + word[i + 1 :], word[:i] + draw.choice(letters) + word[i:], word[:i] + draw.choice(letters) + word[i + 1 :], word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :] if i else word])

    for _ in range(400):
        given, family = ("".join(draw.choice(letters) for _ in range(draw.randrange(3, 11))) for _ in "ab")
        for a, b in ((slip(given), family), (given, slip(family))):
            if min(map(len, (a, b))) > 1:
                assert set(N.name_blocks(sorted([given, family]), "")) & set(N.name_blocks(sorted([a, b]), "")), (given, family, a, b)
        assert set(N.name_blocks([slip(family)], given[0])) & set(N.name_blocks(sorted([given, family]), "")), (given, family)
        city = given * 2
        words, _, options = O.read(f"{city} State Observatory of {family}")
        other, _, others = O.read(f"{slip(city)} State Observatory of {family}")
        assert O.compare(words, other) != O.SAME or set(O.blocks(words, options)) & set(O.blocks(other, others))


def test_clusters_have_every_row_once(spark):
    rows = [(1, "Ann Lee", None, "University of Tigo", None), (2, "Lee, Ann", None, "Tigo Univ.", None), (3, "Bo Chan", None, None, None), (4, None, None, "  ", None), (None, "Bo Chan", None, "Elsewhere Institute", None)]
    got = {tuple(r) for r in N.clusters(spark.createDataFrame([(*r, "clash") for r in rows], PERSON)).collect()}
    assert got == {("name", 1, 1, 2), ("name", 2, 1, 2), ("name", 3, 3, 1), ("affiliation", 1, 1, 2), ("affiliation", 2, 1, 2)}


def test_jaro_winkler():
    assert abs(N.jaro_winkler("martha", "marhta") - 0.9611) < 1e-4
    assert N.jaro_winkler("", "a") == 0.0 and N.jaro_winkler("a", "a") == 1.0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    spread = spark.createDataFrame(edges, "u long, v long").repartition(7)
    assert {r.node: r.label for r in connected_components(spread).collect()} == got
    assert connected_components(spread.limit(0)).collect() == []
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[200] == 200
