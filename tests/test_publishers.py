"""Publishers' pages, invented: what a parser reads, and that what it can't be sure of fails."""

import json

import pytest

from cartulary.catalogue import games
from cartulary.sources import adapters, corrections, digimon, fusion_world, pokemon_pages


def fails(parse, *pages):
    for page in pages:
        with pytest.raises((ValueError, KeyError, TypeError, StopIteration)):
            parse(*page) if isinstance(page, tuple) else parse(page)


def admitted(game, got):
    assert games.admit(game, "card", got["card"]["attributes"])[1:] == ([], [])
    assert games.admit(game, "printing", got["printing"]["attributes"])[1:] == ([], [])


# --- a list with pop-ups

ROWS = {"Color": "Red/Blue", "Play Cost": "5", "DP": "6000", "Form": "Rookie", "Attribute": "-", "Type": "Beast/Bird", "Digivolve Cost 2": "Multicolor 2 from Appli", "Digivolve Cost 1": "Red/Blue 3 from Lv.3", "[Effect]": "Draw 1.", "Link DP": "DP+2000"}
ASKED = """<ul class="cardFaqList"><li class="cardFaqListItem"><p class="cardFaqNum">Q1</p><dl><dt class="cardFaqQuestion">May I?</dt><dd class="cardFaqAnswer">Yes.
  <div class="relatedBox"><p class="relatedTit">Related Cards</p><ul><li><a href="/list?free=AA1-002"><img alt="AA1-002"></a></li></ul></div></dd></dl></li></ul>"""


def member(locator="AA1-001", number="AA1-001", kind="Digimon", rows=ROWS, page=1, parallel="", asked=ASKED):
    pairs = "".join(f"<dl><dt>{k}</dt><dd>{v}</dd></dl>" for k, v in rows.items())
    return f"""<li class="image_lists_item data page-{page}"><a class="card_img" data-src="#{locator}"></a><div class="popupCol" id="{locator}">
      <ul class="cardTitleList"><li class="cardNo">{number}</li><li class="cardRarity">R</li><li class="cardType">{kind}</li><li class="cardLv">Lv.4</li>{parallel}</ul>
      <div class="cardTitle">Walker</div><div class="cardImgInner"><img data-src="/i/{locator}.png"></div><div class="cardInfoCol">{pairs}{asked}</div></div></li>"""


def listed(*members, pagers=1):
    return '<div class="paging"></div>' * pagers + "<ul>" + "".join(members) + "</ul>"


def test_a_list_with_popups():
    url = "https://x.test/list?category=1&cardcategory=Digimon"
    other = member("AA1-001_P2", parallel='<li class="cardParallel">Alternative Art</li>', page=2, asked="")
    one, two = digimon.card_list_of(listed(member(), other), url)
    a = one["card"]["attributes"]
    assert (a["card_type"], a["level"], a["play_cost"], a["dp"], a["attribute"], a["link_dp"]) == ("digimon", 4, 5, 6000, None, 2000)
    assert a["digivolution_requirements"] == [
        {"index": 1, "from_level": 3, "colours": ["blue", "red"], "cost": 3, "raw_condition": "Red/Blue 3 from Lv.3"},
        {"index": 2, "from_level": None, "colours": [], "cost": 2, "raw_condition": "Multicolor 2 from Appli"},
    ]
    assert a["text_sections"] == [{"kind": "effect", "text": "Draw 1."}] and one["other_fields"] == {}
    assert one["questions"] == [{"number": "Q1", "question": "May I?", "answer": "Yes.", "date": None, "related_cards": ["AA1-002"]}]
    assert (one["identity"]["variant"], two["identity"]["variant"], two["printing"]["attributes"]) == ("base", "alternate-art-2", {"alternative_art": True})
    for x in (one, two):
        admitted("digimon", x)
    assert digimon.card_list()(listed()) == []
    fails(lambda page: digimon.card_list_of(page, url), listed(member(page=2)), listed(member(), pagers=0), listed(member(number="AA1-002")), listed(member("AA1-001_P1")), listed(member(kind="Tamer")), listed(member(kind="Rock")))
    fails(digimon.card_list(), listed(member(rows={**ROWS, "Digivolve Cost 1": "Pink 3 from Lv.3"})), listed(member(rows={**ROWS, "DP": "many"})), listed(member(parallel='<li class="odd">x</li>')), listed(member(asked=ASKED.replace('alt="AA1-002"', 'alt="AA1-003"'))), listed(member()) + '<div class="popupCol"></div>')


# --- cards with two faces

SINGLE = {"Card type": "BATTLE", "Color": '<i data-color="Red"></i>', "Cost": "3", "Specified cost": '<span class="costIcon-red"></span><span class="costIcon-red"></span>', "Power": "15000", "Combo power": "5000", "Special Traits": "Hero/Team", "Skills": "Draw 1.", "Where to get it": "Some Box"}
NOTICE = '<div class="cardNotesBtnCol"><a class="cardNotesBtn" href="/errata#1">Errata Notice</a></div>'
FACES = '<div class="data is-front">{}</div><div class="data is-back">{}</div>'


def detail(rows=SINGLE, number="FB01-001", head='<h1 class="cardName">Walker</h1><div class="cardImage"><img src="/i/1.webp"></div>', rarity='<div class="rarity">R</div>', marks=None):
    cells = "".join(f'<div class="cardDataCell"><h6>{k}{(marks or {}).get(k, "")}</h6>{v if v.startswith("<div") else f"""<div class="data">{v}</div>"""}</div>' for k, v in rows.items())
    return f'<div class="cardNo">{number}</div>{rarity}{head}{cells}<div class="informationCol"></div>'


def test_cards_with_two_faces():
    url = "https://x.test/detail?card_no=FB01-001&p=_p1"
    (got,) = fusion_world.card_detail(detail(), url)
    a = got["card"]["attributes"]
    assert (a["card_type"], a["colours"], a["cost"], a["specified_cost"], a["combo_power"]) == ("battle", ["red"], 3, [{"colour": "red", "count": 2}], 5000)
    assert (got["identity"]["locator"], got["identity"]["variant"], got["printed_rules"], got["images"]) == ("FB01-001_p1", "_p1", "Draw 1.", {"front": "/i/1.webp"})
    admitted("fusion-world", got)
    leader = {**SINGLE, "Card type": "LEADER", "Cost": "-", "Specified cost": "-", "Power": FACES.format("15000", "20000"), "Special Traits": FACES.format("Hero", "Hero"), "Skills": FACES.format("Draw 1.", "Rest it." + NOTICE)}
    head = '<h1 class="cardName is-front">Walker</h1><h1 class="cardName is-back">Runner</h1><div class="img-front"><img src="/f.webp"></div><div class="img-back"><img src="/b.webp"></div>'
    mark = {"Skills": '<span class="is-back"> (Errata Applied)</span>'}
    (got,) = fusion_world.card_detail(detail(leader, head=head, marks=mark), url)
    assert [(f["name"], f["power"], f["skills"]) for f in got["card"]["attributes"]["leader_faces"]] == [("Walker", 15000, "Draw 1."), ("Runner", 20000, "Rest it.")]
    assert got["printed_rules"] == "Draw 1." and got["corrected"] == [{"field": "Skills", "face": "back", "notice": "/errata#1"}]
    admitted("fusion-world", got)
    marked = {**SINGLE, "Skills": "Draw 1." + NOTICE}
    (got,) = fusion_world.card_detail(detail(marked, marks={"Skills": '<span class="is-front"> (Errata Applied)</span>'}), url)
    assert got["printed_rules"] is None and got["card"]["rules_text"] == "Draw 1."
    (got,) = fusion_world.card_detail(detail({**SINGLE, "Card type": "ENERGY MARKER", "Color": "-"}, rarity=""), url)
    assert got["printing"]["rarity"] is None and got["card"]["attributes"]["colours"] == ["colourless"]
    one_face = head.replace("img-back", "img-side")
    fails(
        lambda *x: fusion_world.card_detail(*x), (detail(number="FB01-002"), url), (detail(), url + "&q=1"), (detail(), "https://x.test/detail"), (detail(rarity=""), url), (detail(marked), url),
        (detail(leader, head=one_face, marks=mark), url), (detail({**SINGLE, "Specified cost": "two"}), url), (detail({k: v for k, v in SINGLE.items() if k != "Power"}), url), (detail(marks={"Cost": '<span class="is-front"> (Errata Applied)</span>'}), url),
    )


def test_a_product_index():
    item = '<li class="prpductListItem cardCol"><a class="cardLink" href="/p/{0}"><h3 class="cardText">Box {0}</h3></a><dl><dt>RELEASE</dt><dd>May 1, 2026</dd></dl></li>'
    anchors = '<li class="ankerListItem"><a href="#available">AVAILABLE NOW</a></li><li class="ankerListItem"><a href="#comingsoon">COMING SOON</a></li>'
    sections = f'<section class="contentsColInner availableCol" id="available"><ul>{item.format(1)}</ul></section><section class="contentsColInner comingsoonCol" id="comingsoon"><ul>{item.format(2)}</ul></section>'
    assert [(x["name"], x["url"], x["status"], x["released"]) for x in fusion_world.product_index(anchors + sections)] == [("Box 1", "/p/1", "released", "May 1, 2026"), ("Box 2", "/p/2", "announced", "May 1, 2026")]
    fails(fusion_world.product_index, sections, anchors + sections.replace('id="comingsoon"', 'id="later"'), anchors + sections.replace("RELEASE", "OUT"))


# --- correction pages


def correction(number="AA01-001", labels=("Before:", "After:"), cls="detailCol mtS", fragment="e1", day="", note=""):
    pairs = "".join(f'<dt class="txtBlack mtS">{x}</dt><dd>{"Draw 2." if x == "Before:" else "Draw<br>1."}</dd>' for x in labels)
    return f'<div class="{cls}" id="{fragment}"><h5 class="smallTitRed">{day}{number} Walker</h5><div class="typographicalWrap mtS"><div class="typographicalImg"><img alt="" src="/i/1.png"></div></div><dl>{pairs}</dl><ul class="commonNoticeList isHalf">{note}</ul></div>'


def corrected(*sections):
    made = "".join(f'<section class="contentsLCol" id="s{i}"><section class="contentsMCol"><h4 class="mediumTit">March 5, 2026</h4></section>{x}</section>' for i, x in enumerate(sections))
    return f'<h3 class="pageTit">Errata Cards</h3><div class="contentsWrap"><p class="mtS">Hello.</p>{made}</div>'


def test_correction_pages():
    modal = '<ul><li><a class="modalOpen" data-src="#m1"><img></a>' + correction("AA01-002", cls="errataModal", fragment="m1", day="June 1, 2025<br>", note="<li>Also applies to parallel card version.</li>") + "</li></ul>"
    one, two = corrections.one_piece_corrections(corrected(correction(), modal))
    assert (one["card_number"], one["name"], one["published_on"], one["before"], one["after"], one["parallel_printings"]) == ("AA01-001", "Walker", "2026-03-05", "Draw 2.", "Draw 1.", False)
    assert (two["card_number"], two["published_on"], two["fragment"], two["parallel_printings"]) == ("AA01-002", "2025-06-01", "m1", True)
    fails(
        corrections.one_piece_corrections, corrected(), corrected(""), corrected(correction(labels=("Before:",))), corrected(correction(labels=("Before:", "After:", "After:"))), corrected(correction(labels=("Before:", "After:", "Else:"))),
        corrected(modal.replace("#m1", "#m2")), corrected(correction(number="none")), corrected(correction().replace("/i/1.png", "i.png")), corrected(correction()).replace("Errata Cards", "News"),
    )
    entry = {"entry_id": "e1", "card_number": "FB01-001", "published_on": "2026-03-05", "effective_from": None, "before": "Draw 2.", "after": "Draw 1.", "notice": "Both.", "image_url": "https://x.test/1.png"}
    parse = corrections.structured(corrections.ENTRY_FIELDS["fusion-world-en"])
    (got,) = parse(json.dumps({"entries": [entry]}))
    assert (got["card_number"], got["before"], got["effective_from"], got["parallel_printings"]) == ("FB01-001", "Draw 2.", None, True)
    fails(parse, json.dumps({"entries": [{**entry, "more": 1}]}), json.dumps({"entries": [{**entry, "after": " "}]}), json.dumps({}))
    body = '<article><time datetime="Feb 9, 2026"></time><p>An error was found for Walker (Sun & Sea—Bright Stars, 109/172). Effective immediately, it reads anew.</p><p style="color: black; x">Draw 2.</p><p style="color: black; x">Draw 1.</p></article>'
    (got,) = corrections.pokemon_correction(body)
    assert (got["name"], got["set"], got["collector_number"], got["effective_from"], got["before"], got["after"]) == ("Walker", "Bright Stars", "109/172", "2026-02-09", "Draw 2.", "Draw 1.")
    fails(corrections.pokemon_correction, body.replace("Draw 2.", "Draw 1."), body.replace("109/172", "none"), body.replace("Feb 9", "9 Feb"))


# --- a publisher's card page


def shown(number="109/172 Rare Holo", weakness=""):
    return f"""<section class="mosaic section card-detail" data-card-id="aa9/109"><img src="/i/109.png"><h1>Walker</h1><h2>Stage 2 Pokémon</h2><h4>Evolves From: <a>Stepper</a></h4>
      <span class="card-hp"><span>HP</span>160</span><a href="/c?card-dragon=on"><i title="Dragon"></i></a><div class="ability"><h3><div>Ability</div><div>Quick Step</div></h3><p>Draw 1.</p></div>
      <div class="ability"><ul class="left"><li data-energy-type="Water"></li><li data-energy-type="Fighting"></li></ul><h4 class="left label">Kick</h4><span class="right plus">160</span><pre>Discard 2.</pre></div>
      <div class="stat"><h4>Weakness</h4>{weakness}</div><div class="stat"><h4>Resistance</h4></div><a href="/c?retreatCostMin=1&retreatCostMax=1"></a>
      <div class="stats-footer"><h3><a href="/s">Bright Stars</a></h3><span>{number}</span></div><a href="/c?particularArtist=A">A. B.</a></section>"""


def test_a_card_page_of_a_publisher():
    (got,) = pokemon_pages.card_page(shown())
    a = got["card"]["attributes"]
    assert (a["hp"], a["types"], a["stage"], a["evolves_from"], a["retreat_cost"], a["weaknesses"]) == (160, ["Dragon"], "Stage2", "Stepper", 1, [])
    assert a["abilities"] == [{"kind": "Ability", "name": "Quick Step", "text": "Draw 1."}] and a["attacks"] == [{"name": "Kick", "cost": ["Water", "Fighting"], "damage": "160", "text": "Discard 2."}]
    assert got["card"]["rules_text"] == "Quick Step: Draw 1.\nKick: Discard 2." and got["printing"]["attributes"]["finish"] == "holo" and got["printing"]["attributes"]["artists"] == ["A. B."]
    admitted("pokemon", got)
    (got,) = pokemon_pages.card_page(shown(weakness='<ul><li><i title="Fire"></i>×2</li></ul>'))
    assert got["card"]["attributes"]["weaknesses"] == [{"type": "Fire", "value": "×2"}]
    fails(pokemon_pages.card_page, shown(number="Rare"), shown().replace("data-card-id", "data-x"), shown().replace('class="card-hp"', ""), shown(weakness="×2"))


def test_pages_by_their_url(spark):
    registry = adapters.Registry()
    for module in (digimon, fusion_world, corrections, pokemon_pages):
        module.register(registry)
    url = "https://x.test/detail?card_no=FB01-001"
    pages = [("1", "fusion-world-en", "card-detail", detail(), url), ("2", "fusion-world-en", "card-detail", detail(), None), ("3", "digimon-en", "card-list", listed(member()), "https://x.test/l?cardcategory=tamer")]
    snapshots = spark.createDataFrame(pages, "snapshot_id string, lineage string, surface string, body string, url string")
    got = {r.snapshot_id: (r.record is not None, r.failure is None) for r in adapters.observe(snapshots, registry).collect()}
    assert got == {"1": (True, True), "2": (False, False), "3": (False, False)}
    assert sum(r.failure is None for r in adapters.observe(snapshots.drop("url"), registry).collect()) == 0
