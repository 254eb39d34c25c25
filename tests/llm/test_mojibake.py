import pytest

from coursewright.llm import mojibake as M
from tests.conftest import rows

GOOD = [
    "Le coût moyen n’excède jamais 79 unités, même à l’échelle 407. Où faut-il placer le nœud ?", "Überprüfen Sie die Größe: für jeden Zähler gibt es höchstens 93 Schlüssel.", "A SEÇÃO 4: NÃO mova o vetor antes da seleção. A solução é válida.",
    "¿Cuántas páginas leerá el árbol después de 1420 señales? Año, pequeño, búfer.", "Докажите, что блок содержит 49 рёбер и 14 вершин. Каждый процесс хранит ключи.", "Its cost is ½ · 3564 × 26 µs, see § 2140; x ≤ 30 → y, √9 = 3, 7 °C ± 2, Θ(n log n), Ω(n).",
    "┌───┬───┐\n│ a │ 1 │\n└───┴───┘", "Škarvin’s “busy lock” – naïve café 🙂 👩‍🔬 図1 ✔", "plain ASCII only", "",
]


@pytest.mark.parametrize("text", GOOD)
def test_good_text_is_left_alone(text):
    assert M.repair(text) == (False, text, [])


def garble(text, right, wrong):
    raw = text.encode(right)
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "cp1250"])
@pytest.mark.parametrize("i", [0, 1, 3])
def test_utf8_read_as_something_else_comes_back(i, wrong):
    bad = garble(GOOD[i], "utf-8", wrong)
    garbled, fixed, edges = M.repair(bad)
    assert garbled and fixed == GOOD[i] and edges


@pytest.mark.parametrize(("right", "wrong"), [("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp1252")])
def test_cyrillic_in_the_wrong_code_page(right, wrong):
    text = "Докажите, что блок содержит 49 рёбер и 14 вершин."
    assert M.repair(garble(text, right, wrong))[:2] == (True, text)


def test_twice_garbled_and_garbled_in_places():
    twice = garble(garble(GOOD[1], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert M.repair(twice)[1] == GOOD[1]
    mixed = GOOD[0] + "\n" + garble(GOOD[1], "utf-8", "mac_roman") + "\n" + GOOD[3]
    assert M.repair(mixed)[1] == GOOD[0] + "\n" + GOOD[1] + "\n" + GOOD[3]


def test_lost_characters_are_found_and_stay():
    assert M.repair("Apr�s l�op�ration") == (True, "Apr�s l�op�ration", [])
    assert M.repair(None) == (False, None, [])


def test_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "naÃ¯ve cafÃ©"), (3, "naÃ¯ve cafÃ©"), (4, "x" * 200_000 + "Ã©")], "doc_id long, text string")
    out = M.repair_column(df, "doc_id", "text")
    assert [(r.doc_id, r.garbled) for r in out.orderBy("doc_id").collect()] == [(1, False), (2, False), (3, True), (3, True), (4, True)]
    assert rows(M.garbled_only(out).filter("doc_id = 3").select("restored"))[0] == ("naïve café",)


def test_escapes_lead_to_the_original():
    assert M.repair("caf&Atilde;&copy; and more text") == (True, "café and more text", ["cp1252>utf-8", "unescape"])
    assert M.repair("caf&Atilde;&copy; – and more text")[:2] == (True, "café – and more text")
    assert M.repair("caf&amp;Atilde;&amp;copy;")[:2] == (True, "café")
    assert M.repair("caf&eacute; x") == (False, "café x", ["unescape"])  # escaped, not wrongly decoded
    assert M.repair("if (a &lt; b &amp;&amp; c) &foo; AT&T;") == (False, "if (a &lt; b &amp;&amp; c) &foo; AT&T;", [])


def test_damage_of_any_depth_comes_back():
    bad = "Größe der Straße"
    for _ in range(6):
        bad = garble(bad, "utf-8", "cp1252")
    assert M.repair(bad)[:2] == (True, "Größe der Straße")
