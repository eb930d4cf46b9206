"""Names, slugs, types and keys, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions import signals

#: Accented letters and what is left of each without its mark; Spark has no Unicode decomposition.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
#: Abbreviations of place names, articles.
ABBREVIATIONS = {"blvd": "boulevard", "ave": "avenue", "hwy": "highway", "pkwy": "parkway", "mt": "mount", "ft": "fort"}
ARTICLES = ("the", "a", "an", "el", "la", "los", "las")
STOPWORDS = ("the", "and", "bar", "grill", "restaurant", "cafe", "kitchen", "pub", "house", "of", "at", "on", "in", "co", "a")

CHAINS = (
    "mcdonalds", "burger king", "wendys", "taco bell", "kfc", "popeyes", "chick fil a", "chipotle", "subway", "jimmy johns", "jersey mikes", "arbys",
    "jack in the box", "carls jr", "sonic drive in", "dairy queen", "little caesars", "dominos", "papa johns", "pizza hut", "panda express", "five guys",
    "in n out", "del taco", "wingstop", "raising canes", "panera", "qdoba", "wienerschnitzel", "churchs chicken", "churchs texas chicken", "mod pizza",
    "blaze pizza", "dutch bros", "starbucks", "jollibee", "loves travel stop", "culvers", "waffle house", "first watch", "salad and go", "filibertos",
    "mesquite fresh", "petes fish chips", "petes fish and chips", "lolos chicken waffles", "lolos chicken and waffles", "red lobster", "olive garden", "chilis",
    "tgi fridays", "fridays", "outback steakhouse", "texas roadhouse", "dennys", "ihop", "black angus", "famous daves", "buffalo wild wings", "hooters",
    "round table pizza", "macaroni grill", "claim jumper", "ruby tuesday", "golden corral", "sharis", "elmers", "mod sushi", "bjs restaurant", "bjs brewhouse",
    "the old spaghetti factory", "old spaghetti factory", "texas de brazil", "kura revolving sushi", "kura sushi", "stack 571", "peter piper pizza", "cocos",
    "tahoe joes", "chuck e cheese", "dave busters", "dave and busters", "round 1", "round1", "spare time", "bowlero", "main event", "topgolf", "gameworks",
)
OFFER_CHAINS = (
    "applebees", "chilis", "tgi fridays", "fridays", "outback steakhouse", "yard house", "bjs restaurant", "bjs brewhouse", "buffalo wild wings", "hooters",
    "red robin", "black angus", "ruby tuesday", "claim jumper", "macaroni grill", "texas de brazil", "dave busters", "dave and busters", "round 1", "round1",
    "bowlero", "main event", "topgolf", "gameworks",
)
TYPE_OF = {
    "bar": "bar", "sports_bar": "sports_bar", "cocktail_bar": "cocktail_lounge", "lounge_bar": "cocktail_lounge", "wine_bar": "wine_bar", "pub": "pub",
    "irish_pub": "pub", "brewery": "brewery", "beer_garden": "bar", "night_club": "club", "gastropub": "gastropub", "cafe": "cafe", "coffee_shop": "cafe",
    "pizza_restaurant": "pizzeria", "pizzeria": "pizzeria", "live_music_venue": "bar", "sports_complex": "other",
}
RESTAURANTS = "restaurant bar_and_grill steak_house fine_dining_restaurant brunch_restaurant buffet_restaurant diner food_court meal_takeaway meal_delivery fast_food_restaurant".split()
NAME_RULES = (
    (r"\bsports\s?bar\b", "sports_bar"), (r"\bwine\s?bar\b", "wine_bar"), (r"\b(brew(ery|ing)|brewhouse|brewpub)\b", "brewery"),
    (r"\b(taproom|tap\s?house|tasting\s?room|cellars?|winery|vineyard)\b", "tasting_room"), (r"\b(pub|alehouse|ale\s?house)\b", "pub"),
    (r"\b(cantina|tequila|saloon)\b", "bar"), (r"\b(night\s?club|nightclub)\b", "club"), (r"\blounge\b", "cocktail_lounge"), (r"\bpizz(a|eria)\b", "pizzeria"),
    (r"\b(caf[eé]|coffee|espresso)\b", "cafe"), (r"\b(bar|tavern)\b", "bar"),
)
LABELS = {
    "restaurant": "Restaurant", "bar": "Bar", "sports_bar": "Sports Bar", "pub": "Pub", "dive_bar": "Dive", "wine_bar": "Wine Bar", "brewery": "Brewery",
    "tasting_room": "Taproom", "cocktail_lounge": "Cocktails", "gastropub": "Gastropub", "club": "Club", "cafe": "Café", "hotel_bar": "Hotel",
    "pizzeria": "Pizzeria", "other": "Venue",
}
PRIOR = {
    "sports_bar": 0.62, "bar": 0.61, "pub": 0.58, "irish_pub": 0.58, "gastropub": 0.58, "brewery": 0.56, "brewpub": 0.56, "wine_bar": 0.41, "cocktail_bar": 0.29,
    "lounge_bar": 0.29, "night_club": 0.33, "american_restaurant": 0.57, "new_american_restaurant": 0.57, "italian_restaurant": 0.56, "bar_and_grill": 0.5,
    "restaurant": 0.45, "pizza_restaurant": 0.32, "mexican_restaurant": 0.33, "latin_american_restaurant": 0.33, "steak_house": 0.2, "sushi_restaurant": 0.19,
    "japanese_restaurant": 0.19, "ramen_restaurant": 0.17, "barbecue_restaurant": 0.14, "chinese_restaurant": 0.08, "seafood_restaurant": 0.07,
    "thai_restaurant": 0.0, "vegan_restaurant": 0.0, "vegetarian_restaurant": 0.0, "indian_restaurant": 0.0, "cafe": 0.0, "coffee_shop": 0.0, "bakery": 0.0,
}
TYPE_PRIOR = {
    "sports_bar": 0.62, "bar": 0.6, "pub": 0.58, "dive_bar": 0.5, "wine_bar": 0.41, "brewery": 0.56, "tasting_room": 0.4, "cocktail_lounge": 0.35,
    "gastropub": 0.58, "club": 0.33, "hotel_bar": 0.5, "pizzeria": 0.32, "cafe": 0.0, "restaurant": 0.4,
}
NAME_FLOORS = (
    (r"(?i)\b(sports?\s*bar|cantina|tavern|ale\s*house|brew(ery|pub|ing)?|saloon)\b", 0.58),
    (r"(?i)\b(bar\s*(&|and)\s*grill|grill(e)?|pub|gastropub)\b", 0.55),
    (r"(?i)\b(cocktail|lounge|wine\s*bar)\b", 0.41),
)
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "DC": "Washington, D.C.", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
    "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
    "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "AS": "American Samoa", "GU": "Guam", "MP": "Northern Mariana Islands", "PR": "Puerto Rico",
    "VI": "U.S. Virgin Islands",
}


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def plain(text: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[̀-ͯ]", "")


def normalised(name: Column) -> Column:
    """Apostrophes dropped, all else but letters and digits one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(plain(name), "['‘’]", ""), "[^a-z0-9]+", " "))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(plain(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def change_slug(name: Column) -> Column:
    """The slug of applied changes: quotes dropped, 80 characters at most, "venue" if nothing is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), "['\"’]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.when(s == "", "venue").otherwise(s)


def area_slug(name: Column) -> Column:
    """The slug of areas, whose dashes at the ends stay."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")


def place_suffix(place_id: Column) -> Column:
    s = F.right(F.regexp_replace(F.lower(place_id), "[^a-z0-9]", ""), F.lit(6))
    return F.when(s == "", "loc").otherwise(s)


def without_promo(name: Column) -> Column:
    """Bracketed groups that advertise are dropped, with the space and punctuation that they leave; never the whole name."""
    cut = F.regexp_replace(name, rf"(?i)[(\[](?=[^()\[\]]*{signals.PROMO})[^()\[\]]*[)\]]", "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, r"\s{2,}", " "), r"\s+([,.;:])", "$1"), r"[\s\-–—|]+$", ""))
    return F.when(cut == name, name).when(clean == "", F.trim(name)).otherwise(clean)


def tokens(name: Column) -> Column:
    return F.filter(F.split(plain(name), "[^a-z0-9]+"), lambda t: t != "")


def area_tokens(name: Column) -> Column:
    """Tokens, abbreviations written out; a first "st" is a saint, a later one a street."""
    return F.transform(tokens(name), lambda t, i: F.when(t == "st", F.when(i == 0, "saint").otherwise("street")).otherwise(F.coalesce(lookup(ABBREVIATIONS, t), t)))


def area_key(name: Column) -> Column:
    return F.array_join(area_tokens(name), "")


def synonym_keys(name: Column, city: Column) -> Column:
    """The key, and what is left without a final "village" or the city's name at either end."""
    t, k, c = area_tokens(name), area_key(name), area_key(city)
    head = F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))
    village = F.when((F.size(t) > 1) & (F.element_at(t, -1) == "village") & ~((F.size(head) == 1) & head[0].isin(*ARTICLES)), F.array_join(head, ""))
    longer = (c != "") & (F.length(k) > F.length(c))
    front, back = F.when(longer & k.startswith(c), F.substr(k, F.length(c) + 1)), F.when(longer & k.endswith(c), F.substr(k, F.lit(1), F.length(k) - F.length(c)))
    return F.array_distinct(F.filter(F.array(k, village, front, back), lambda x: x.isNotNull()))


def near_keys(a: Column, b: Column, shortest: int = 6) -> Column:
    """At most one edit apart, and long enough to tell."""
    return (F.length(a) >= shortest) & (F.length(b) >= shortest) & (F.levenshtein(a, b, 1) >= 0)


def names_match(a: Column, b: Column) -> Column:
    """One name's tokens contain the other's, or half of all tokens are shared; stop words don't count."""
    own = lambda n: F.array_distinct(F.filter(tokens(n), lambda t: ~t.isin(*STOPWORDS)))
    x, y = own(a), own(b)
    both = F.size(F.array_intersect(x, y))
    return (F.size(x) > 0) & (F.size(y) > 0) & ((both == F.least(F.size(x), F.size(y))) | (both / F.size(F.array_union(x, y)) >= 0.5))


def has_phrase(text: Column, phrases, ends: bool = False) -> Column:
    """A normalised text is a phrase, begins with it or holds it between spaces (with ``ends``: or ends with it)."""
    body = "|".join(phrases)
    return F.coalesce(text.rlike(rf"^(?:{body})(?: |$)| (?:{body})(?:{' |$' if ends else ' '})"), F.lit(False))


def offer_chain(name: Column) -> Column:
    return has_phrase(normalised(name), OFFER_CHAINS)


def denied_chain(name: Column) -> Column:
    return has_phrase(normalised(name), CHAINS) & ~offer_chain(name)


def no_offer_format(name: Column, host: Column) -> Column:
    n = normalised(name)
    return has_phrase(n, signals.NO_OFFER_FORMATS, True) | F.coalesce(n.rlike(r"\belks ?\d|\blodge no ?\d"), F.lit(False)) | F.coalesce(host.rlike("|".join(signals.MEMBER_HOSTS)), F.lit(False))


def alcohol_signal(name: Column, primary: Column, types: Column) -> Column:
    n = normalised(F.coalesce(name, F.lit("")))
    words = F.split(n, " ")
    return (
        F.coalesce(primary.isin(*signals.ALCOHOL_TYPES), F.lit(False))
        | F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(t) for t in signals.ALCOHOL_TYPES])), F.lit(False))
        | n.rlike("|".join(signals.ALCOHOL_PHRASES))
        | F.exists(words, lambda w: w.isin(*signals.ALCOHOL_WORDS) | w.startswith("brew"))
    )


def bowling(name: Column, primary: Column, types: Column) -> Column:
    return F.coalesce(primary == "bowling_alley", F.lit(False)) | F.coalesce(F.array_contains(types, "bowling_alley"), F.lit(False)) | F.exists(F.split(normalised(F.coalesce(name, F.lit(""))), " "), lambda w: w.isin("bowling", "lanes"))


def excluded_type(primary: Column, types: Column) -> Column:
    t = F.coalesce(types, F.array().cast("array<string>"))
    has = lambda x: F.array_contains(t, x)
    p = F.coalesce(primary, F.lit(""))
    return (
        F.when((p == "casino") | has("casino"), True)
        .when(p.isin(*signals.ALCOHOL_TYPES), False)
        .otherwise(p.isin(*signals.EXCLUDED_TYPES) | F.arrays_overlap(t, F.array(*[F.lit(x) for x in signals.EXCLUDED_ANY_TYPE])) | F.coalesce(F.get(t, F.lit(0)) == "breakfast_restaurant", F.lit(False)) | (p == "chinese_restaurant") & has("breakfast_restaurant"))
    )


def closed_business(status: Column) -> Column:
    return F.coalesce(status.isin("CLOSED_PERMANENTLY", "CLOSED_TEMPORARILY"), F.lit(False))


def low_signal(reviews: Column, name: Column, primary: Column, types: Column, least: int = 25) -> Column:
    return ~alcohol_signal(name, primary, types) & (F.coalesce(reviews, F.lit(0)) < least)


def _of_type(t: Column) -> Column:
    return F.coalesce(lookup(TYPE_OF, t), F.when(t.isin(*RESTAURANTS) | t.endswith("_restaurant"), "restaurant"))


def place_type(primary: Column, types: Column, name: Column) -> Column:
    """By the primary type, else the first type that says anything, else the first rule that the name matches."""
    by_name = F.coalesce(*[F.when(name.rlike(f"(?i){p}"), t) for p, t in NAME_RULES])
    return F.coalesce(_of_type(primary), F.get(F.filter(F.transform(types, _of_type), lambda t: t.isNotNull()), F.lit(0)), by_name, F.lit("restaurant"))


def type_label(t: Column) -> Column:
    return F.coalesce(lookup(LABELS, t), F.lit(""))


def likelihood(primary: Column, types: Column, name: Column) -> Column:
    """0 to 1: the prior of the primary type, else of the first type that has one, else of the derived type; names of some
    kinds lift it to a floor. Null without any evidence."""
    first = F.get(F.filter(F.transform(types, lambda t: lookup(PRIOR, F.lower(t))), lambda x: x.isNotNull()), F.lit(0))
    told = F.coalesce(primary != "", F.lit(False)) | (F.coalesce(F.size(types), F.lit(0)) > 0) | (F.trim(F.coalesce(name, F.lit(""))) != "")
    score = F.coalesce(lookup(PRIOR, F.lower(primary)), first, F.when(told, lookup(TYPE_PRIOR, place_type(primary, types, F.coalesce(name, F.lit(""))))))
    floor = F.coalesce(*[F.when(name.rlike(p), f) for p, f in NAME_FLOORS])
    return F.greatest(score, floor)


def state_name(code: Column) -> Column:
    return F.coalesce(lookup(STATES, F.upper(F.trim(code))), F.trim(code))


def salted_hash(salt: str, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value), 256), 1, 32)
