"""The places that folder names are searched for, and how texts are folded for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Search words and the places they stand for, in the order in which they win; None: too ambiguous.
PLACES = {
    "griechenland": "Griechenland", "greece": "Griechenland", "italien": "Italien", "italy": "Italien", "spanien": "Spanien", "spain": "Spanien",
    "portugal": "Portugal", "turkei": "Türkei", "turkey": "Türkei", "thailand": "Thailand", "bali": "Bali", "indonesien": "Indonesien",
    "deutschland": "Deutschland", "germany": "Deutschland", "osterreich": "Österreich", "austria": "Österreich", "schweiz": "Schweiz", "switzerland": "Schweiz",
    "frankreich": "Frankreich", "france": "Frankreich", "niederlande": "Niederlande", "netherlands": "Niederlande", "holland": "Niederlande",
    "danemark": "Dänemark", "denmark": "Dänemark", "norwegen": "Norwegen", "norway": "Norwegen", "schweden": "Schweden", "sweden": "Schweden",
    "island": "Island", "iceland": "Island", "kroatien": "Kroatien", "croatia": "Kroatien", "ungarn": "Ungarn", "hungary": "Ungarn", "polen": "Polen", "poland": "Polen",
    "tschechien": "Tschechien", "czech": "Tschechien", "kanada": "Kanada", "canada": "Kanada", "usa": "USA", "amerika": "USA", "america": "USA",
    "japan": "Japan", "china": "China", "vietnam": "Vietnam", "agypten": "Ägypten", "egypt": "Ägypten", "marokko": "Marokko",
    "belgien": "Belgien", "luxemburg": "Luxemburg", "irland": "Irland", "england": "England", "schottland": "Schottland", "london": "London",
    "mallorca": "Mallorca", "ibiza": "Ibiza", "kreta": "Kreta", "rhodos": "Rhodos",
    "berlin": "Berlin", "hamburg": "Hamburg", "muenchen": "München", "munchen": "München", "koeln": "Köln", "koln": "Köln", "frankfurt": "Frankfurt",
    "stuttgart": "Stuttgart", "duesseldorf": "Düsseldorf", "dusseldorf": "Düsseldorf", "dortmund": "Dortmund", "essen": None, "leipzig": "Leipzig",
    "dresden": "Dresden", "hannover": "Hannover", "nuernberg": "Nürnberg", "nurnberg": "Nürnberg", "bremen": "Bremen", "potsdam": "Potsdam",
    "rostock": "Rostock", "kiel": "Kiel", "luebeck": "Lübeck", "lubeck": "Lübeck", "magdeburg": "Magdeburg", "wien": "Wien", "zuerich": "Zürich", "zurich": "Zürich",
    "amsterdam": "Amsterdam", "paris": "Paris", "prag": "Prag", "rom": "Rom", "barcelona": "Barcelona", "madrid": "Madrid", "lissabon": "Lissabon",
    "groemitz": "Grömitz", "gromitz": "Grömitz", "timmendorf": "Timmendorfer Strand", "scharbeutz": "Scharbeutz", "sylt": "Sylt", "usedom": "Usedom",
    "ruegen": "Rügen", "rugen": "Rügen", "harz": "Harz", "allgaeu": "Allgäu", "allgau": "Allgäu", "ostsee": "Ostsee", "nordsee": "Nordsee", "bodensee": "Bodensee",
}


def place_fold(text: Column) -> Column:
    """Lower case, umlauts spelled out, other accents dropped."""
    spelled = reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")), F.lower(F.trim(text)))
    return F.translate(spelled, "àáâãåçèéêëìíîïñòóôõùúûýÿ", "aaaaaceeeeiiiinoooouuuyy")


def place_words(text: Column) -> Column:
    """The folded words of a text."""
    return F.filter(F.split(place_fold(text), "[^a-z0-9]+"), lambda w: w != "")
