import pytest

from cartulary.catalogue import games
from cartulary.sources import adapters, gundam

ROWS = {"TYPE": "UNIT", "COLOR": "Blue", "Lv.": "4", "COST": "3", "Zone": "Space", "Trait": "Crew", "Link": "-", "AP": "4", "HP": "-", "Source Title": "A Story", "Where to get it": "Some Box"}


def page(image="AA01-001.png", rows=ROWS, number="AA01-001", rarity="R"):
    pairs = "".join(f"<dl><dt>{k}</dt><dd>{v}</dd></dl>" for k, v in rows.items())
    return f"""<main><p class="cardNo">{number}</p><p class="rarity">{rarity}</p><p class="blockIcon">01</p><h1 class="cardName">Walker</h1>
      <figure class="cardImage"><img src="/images/{image}?v=2"></figure>{pairs}<div class="cardDataRow overview"><div>Draw 1.<br>Rest it.</div></div></main>"""


def test_a_card_page():
    (got,) = gundam.card_detail(page())
    assert games.admit("gundam", "card", got["card"]["attributes"])[1:] == ([], []) and games.admit("gundam", "printing", got["printing"]["attributes"])[1:] == ([], [])
    a = got["card"]["attributes"]
    assert (a["card_type"], a["colours"], a["level"], a["hp"], a["link_condition"], a["effect_text"]) == ("unit", ["blue"], 4, None, None, "Draw 1. Rest it.")
    assert got["identity"]["variant"] == "base" and got["printing"] == {"rarity": "R", "attributes": {"alternate_art": False}}
    (other,) = gundam.card_detail(page("AA01-001_p2.png", {**ROWS, "TYPE": "UNIT TOKEN", "COLOR": "-"}))
    assert other["identity"]["variant"] == "_p2" and other["printing"]["attributes"]["alternate_art"] and other["card"]["category"] == "token" and other["card"]["attributes"]["colours"] == []
    for bad in (page("AA01-002.png"), page("AA01-001_p0.png"), page(rows={k: v for k, v in ROWS.items() if k != "TYPE"}), page(rows={**ROWS, "AP": "four"}), page().replace('class="rarity"', ""), page() + '<p class="cardNo">x</p>'):
        with pytest.raises(ValueError):
            gundam.card_detail(bad)


def article(entries, notice="For the applicable cards, the above shall be regarded as the correct wording.", before=""):
    made = "".join(f'<p><span style="font-size: 1.25em">{n} Walker</span></p><img src="/i/{n}.png"><h5>[Before]</h5><div class="text-area">{b}</div><h5>[After]</h5><div class="text-area">{a}</div>' for n, b, a in entries)
    return f'<h2>Errata notice</h2><div class="date">March 5, 2026</div><div class="articleBody">{before}{made}<strong>{notice}</strong></div>'


def test_corrections():
    both = [("AA01-001", "Draw 2.", "Draw 1."), ("AA01-010", "Rest.", "Rest it.")]
    got = gundam.corrections()(article(both))
    assert [(e["card_number"], e["before"], e["after"], e["published_on"], e["parallel_printings"]) for e in got] == [(*x, "2026-03-05", True) for x in both]
    foreign = '<h6>Other</h6><span style="font-size:1.25em">BB01-001</span><h6>English Version</h6>'
    assert len(gundam.corrections(english_part=True)(article(both, before=foreign))) == 2
    assert not gundam.corrections()(article(both, "Only this one is the correct wording"))[0]["parallel_printings"]
    for bad in (article([]), article([*both, both[0]]), article(both).replace("[After]", "Then", 1), article(both).replace("Errata", "News"), article(both).replace("March 5", "5 March"), article(both, "none")):
        with pytest.raises(ValueError):
            gundam.corrections()(bad)
    with pytest.raises(ValueError):
        gundam.corrections(english_part=True)(article(both))


def test_pages_that_fail_are_rows(spark):
    registry = gundam.register(adapters.Registry())
    both = [("AA01-001", "Draw 2.", "Draw 1."), ("AA01-010", "Rest.", "Rest it.")]
    pages = [(1, "gundam-en-us", "card-detail", page()), (2, "gundam-en-us", "card-detail", page("AA01-002.png")), (3, "gundam-en-us", "errata", article(both)), (4, "gundam-en-asia", "errata", article(both))]
    snapshots = spark.createDataFrame([(str(i), *p) for i, *p in pages], "snapshot_id string, lineage string, surface string, body string")
    got = adapters.observe(snapshots, registry).collect()
    assert sorted((r.snapshot_id, r.failure is None) for r in got) == [("1", True), ("2", False), ("3", True), ("3", True), ("4", False)]
