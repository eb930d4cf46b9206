"""Word lists and patterns of the text gates, and the predicates over them, as native expressions.

The lists and patterns below are fixed values: what they match decides which rows pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFER_HOUR = r"(?i)happ(?:y|ier)[-_ ]?hours?|social[-_ ]?hour|power[-_ ]?hour|spritz[-_ ]?hours?|sunset[-_ ]?hours?|sundowners?|vermut[-_ ]?hours?|hora[-_ ]?(?:feliz|del[-_ ]?vermut)|aperitivo|apericena"
TIME_RANGE = r"\b\d{1,2}\s*(?:[ap]\.?m\.?)?\s*[-–—]+\s*\d{1,2}\s*[ap]\.?m\.?"
DEAL = rf"(?i)\bspecials?\b|drink\s*deals?|\bdaily\b|industry\s*night|happy\s*hr\b|{TIME_RANGE}"
PRICE = r"\$\s?\d"
PRICES = r"\$\s?\d+(?:\.\d{2})?"
DEAL_WORDS = r"(?i)\bspecials?\b|drink\s*deals?|\$\d+\s*off|\d+%\s*off|half[-\s]?off|half[-\s]?price|1/2[-\s]?(?:off|price)|\bbogo\b|two[-\s]?for[-\s]?one|industry\s*night"
MENU = r"(?i)\$\s?\d|happy[ -]?hour|\b(?:mon|tue|wed|thu|fri|sat|sun|daily|weekday|weekend)\b|\b\d{1,2}(?::\d{2})?\s?(?:a\.?m\.?|p\.?m\.?|am|pm)\b|\b(?:menu|special|appetizer|cocktail|martini|draft|draught|wine|beer|spirit|well drink|pint|glass|bottle)\b"
PARKED_MARKERS = ("is for sale", "buy this domain", "domain for sale", "this domain is parked", "sedoparking", "bodis.com", "domain is currently available", "godaddy.com/domainsearch")
URLS = r"(?i)https?://\S+"
MENU_DOC = r"(?i)happ(?:y|ier)[-_ ]?hours?|social[-_ ]?hour|power[-_ ]?hour|spritz[-_ ]?hours?|sundowners?|\bhh\b|special|\bmenu\b|\bdrinks?\b|cocktail|\bbar\b|\bwine\b|\bbeer\b|aperitivo|vermut|apericena|hora[-_ ]?(?:feliz|del[-_ ]?vermut)|prix[-_ ]?fixe|tasting"
ALCOHOL = "|".join((
    r"\bcocktails?\b", r"\bmargaritas?\b", r"\bmartinis?\b", r"\bmojitos?\b", r"\bsangria\b", r"\bmimosas?\b", r"\bprosecco\b", r"\bchampagne\b",
    r"\btequila\b", r"\bmezcal\b", r"\bwhiske?y\b", r"\bbourbon\b", r"\bvodka\b", r"\bspirits\b", r"\bdraft beer\b", r"\bdraught\b", r"\bon tap\b",
    r"\bcraft beer\b", r"\bbrewery\b", r"\bipa\b", r"\blagers?\b", r"\bpilsners?\b", r"\bwine list\b", r"\bby the glass\b", r"\bsake\b(?!\s+of\b)",
    r"\bsoju\b", r"\bizakaya\b", r"\b(red|white|glass of) wine\b", r"\bbeer\s*(?:&|and)\s*wine\b", r"\bwine\s*(?:&|and)\s*beer\b", r"\bfull bar\b",
    r"\bbar menu\b", r"\b(cocktail|wine|sports) bar\b", r"\bhapp(?:y|ier)[-\s]?hours?\b", r"\b21\s*\+", r"\bmust be 21\b", r"\b21 (?:and|&) over\b",
))
SQUATTER = ("find restaurants near you", "fromtherestaurant", "discover restaurants near you", "browse restaurants near you")
PARKED = r"(?i)website is ready|content is to be added|this domain is (?:for sale|parked)|buy this domain|domain (?:for sale|parking|is for sale)|under construction|default (?:web ?)?page|ispsystem|account suspended|coming soon|site (?:not found|under maintenance)|future home of|page is parked"
MEAL = r"(?i)\b(?:prix[- ]?fixe|early[- ]?bird|bottomless|paint\s*(?:and|&|'?n'?)\s*sip|\d+[- ]course)\b|\b(?:lunch(?:eon)?|brunch|breakfast|dinner|supper)\b(?!\s+menus?\b)"
MEAL_ALCOHOL = r"(?i)\b(wine|beer|draft|draught|ipa|lager|ale|stout|pilsner|cocktail|martini|margarita|mimosa|sangria|spritz|bottle of wine|tequila|vodka|whiske?y|bourbon|gin|rum|champagne|prosecco|mule|seltzer|cider)\b"
FOOD = r"(?i)\b(burgers?|tacos?|wings?|pizzas?|nachos?|fries|sliders?|shareables?|appetizers?|apps?|flatbreads?|quesadillas?|sandwich(es)?|hot ?dogs?|pretzels?|mozzarella|calamari|dumplings?|egg ?rolls?|tots)\b"
DRINK = r"(?i)\b(beers?|drafts?|draughts?|wines?|cocktails?|margaritas?|sangrias?|mimosas?|wells?|pours?|drinks?|ipa|lagers?|pints?|shots?|spirits?|whiskeys?|whisky|tequilas?|vodkas?|rum|gin|seltzers?|ciders?|brews?|bottles?|cans?|mules?|martinis?|spritz(es)?)\b"
APPETIZER = r"(?i)\b(appetizers?|apps?|shareables?|starters?|small plates?)\b"
PROMO = r"(?:\bopen\s+for\b|\bnow\s+open\b|\bgrand\s+(?:re-?)?opening\b|\bcoming\s+soon\b|\bnewly\s+opened\b|\baward[-\s]?winning\b|\bvoted\b|\bbest\b|#\s*1\b|\bno\.?\s*1\b|\bworld[-\s]?famous\b|\bworld\s*cup\b|\bsuper\s*bowl\b|\bgame\s*day\b|\bwatch\s*part(?:y|ies)\b|\bmust[-\s]?try\b|\blimited[-\s]?time\b|%\s*off\b|\bunder\s+new\s+management\b)"
MONTHLY = r"(?i)\b(every\s+)?(first|second|third|fourth|fifth|last)\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday)s?\b|\bonce\s+a\s+month\b|\bmonthly\b"
EVENT_PATH = r"(?i)(event|wedding|banquet|catering|valentine|hallowe|christmas|nye|new-?year|mothers-?day|fathers-?day|st-?patrick|cinco[-_ ]de[-_ ]mayo|super-?bowl|football|game-?day|festival|limited[-_ ]release)"
SHOP_PATH = r"(?i)/(collections?|products?|shop|store|merch)(/|$)"
NAV_WORDS = (
    "menu menus reservation reservations reserve about contact home order online gift card cards location locations hour hours follow sign up newsletter "
    "catering event events private direction directions career careers shop book booking gallery story team press faq faqs blog login account search more "
    "info view our us and the find call now quick cart bag merch wishlist checkout quantity qty sold"
).split()
SOFT_DRINKS = (
    "coke", "coca cola", "coca-cola", "diet coke", "pepsi", "diet pepsi", "sprite", "7up", "fanta", "dr pepper", "root beer", "ginger ale", "club soda", "soda",
    "shrub soda", "lemonade", "iced tea", "sweet tea", "arnold palmer", "juice", "orange juice", "apple juice", "cranberry juice", "water", "sparkling water",
    "bottled water", "still water", "coffee", "iced coffee", "espresso", "latte", "cappuccino", "americano", "hot chocolate", "milk", "milkshake", "soft drink",
    "fountain drink",
)
JUNK_ALCOHOL = r"(?i)\b(vodka|gin|rum|tequila|whiske?y|bourbon|scotch|brandy|cognac|mezcal|wine|beer|ale|ipa|lager|stout|pilsner|porter|kolsch|cocktail|martini|margarita|mojito|daiquiri|negroni|spritz|sangria|mimosa|mule|sour|fizz|manhattan|cosmo(politan)?|seltzer|cider|prosecco|champagne|aperol|campari|sake|soju|shot|well|draft|draught|pint|jack|tito|hard|spiked|boozy)\b"
STORE_LABEL = r"(?i)^(quick\s*view|add\s+to\s+(cart|bag)|sold\s+out|out\s+of\s+stock|shop\s+(now|all)|buy\s+now|view\s+(product|details|cart)|select\s+options|pre[\s-]?order|notify\s+me)\b"
ALCOHOL_TYPES = "bar pub brewery brewpub wine_bar cocktail_bar sports_bar bar_and_grill night_club distillery irish_pub".split()
ALCOHOL_WORDS = "beer biergarten pub tavern taproom saloon winery distillery cocktail cocktails alehouse meadery cidery speakeasy mezcaleria cantina sake apero aperitivo tequila izakaya".split()
ALCOHOL_PHRASES = ("beer garden", "bier garten", "wine bar", "ale house", "tap room", "public house", "tasting room", "beer hall", "bar grill")
EXCLUDED_TYPES = (
    "bowling_alley food_court food_store grocery_store supermarket convenience_store juice_shop resort_hotel buffet_restaurant breakfast_restaurant family_restaurant "
    "indian_restaurant bakery cafe coffee_shop cafeteria dessert_restaurant dessert_shop deli salad_shop shopping_mall clothing_store service catering_service laundry "
    "educational_institution golf_course country_club coffee_roastery sports_club consultant corporate_office barber_shop beauty_salon art_studio association_or_organization"
).split()
EXCLUDED_ANY_TYPE = "buffet_restaurant acai_shop juice_shop".split()
NEVER_TYPES = "korean_restaurant vietnamese_restaurant chinese_restaurant family_restaurant".split()
NO_OFFER_FORMATS = (
    "buffet", "ayce", "all you can eat", "food truck", "truck", "trailer", "carniceria", "panaderia", "pozoleria", "menuderia", "taqueria", "birrieria", "breakfast",
    "brunch", "diner", "waffle", "acai", "donut", "donuts", "doughnut", "doughnuts", "bookstore", "museum", "theatre", "theater", "cabaret", "gentlemens club",
    "topless", "strip club", "showgirls", "nude", "burlesque", "casino", "elks lodge", "elks club", "vfw", "veterans of foreign wars", "veterans hall",
    "american legion", "amvets", "moose lodge", "loyal order of moose", "eagles aerie", "eagles lodge", "eagles club", "fraternal order", "masonic lodge",
    "masonic temple", "knights of columbus", "ioof", "odd fellows lodge", "oddfellows lodge", "sons of italy", "sons of norway", "senior center",
)
MEMBER_HOSTS = "amvets vfw americanlegion eagleslodge eaglesclub mooselodge elkslodge masoniclodge masonictemple knightsofcolumbus oddfellows".split()
DAY_WORDS = ("mondays?", "tuesdays?", "wednesdays?", "thursdays?", "fridays?", "saturdays?", "sundays?")


#: A word's edge by ASCII letters, digits and "_" alone; to Java's own, an accented letter belongs to the word too.
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def says(text: Column, pattern: str) -> Column:
    """The text has a match, words ending where a letter is not plain ASCII."""
    return text.rlike(pattern.replace(r"\b", EDGE))


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, URLS, " ")


def offer_hour(text: Column) -> Column:
    return F.coalesce(text.rlike(OFFER_HOUR), F.lit(False))


def offer_signal(text: Column) -> Column:
    t = without_urls(text)
    return F.coalesce(t.rlike(OFFER_HOUR) | says(t, DEAL), F.lit(False))


def offer_match(text: Column) -> Column:
    """What matched, the hour words first; null if nothing did."""
    t = without_urls(text)
    first = lambda p: F.nullif(F.regexp_extract(t, f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})", 1), F.lit(""))
    return F.coalesce(first(OFFER_HOUR), first(DEAL))


def price_count(text: Column) -> Column:
    return F.regexp_count(without_urls(text), F.lit(PRICES))


def price_signal(text: Column) -> Column:
    t = without_urls(text)
    return F.coalesce(t.rlike(PRICE) | says(t, DEAL_WORDS), F.lit(False))


def alcohol_content(text: Column) -> Column:
    return F.coalesce(says(text, f"(?i){ALCOHOL}"), F.lit(False))


def squatter(html: Column) -> Column:
    return F.coalesce(F.lower(html).rlike("|".join(SQUATTER)), F.lit(False))


def parked_html(html: Column) -> Column:
    return F.coalesce(F.lower(html).rlike("|".join(x.replace(".", r"\.") for x in PARKED_MARKERS)), F.lit(False))


def parked(text: Column) -> Column:
    return F.coalesce(text.rlike(PARKED), F.lit(False))


def food_as_drink(text: Column) -> Column:
    return F.coalesce(says(text, FOOD) & ~says(text, DRINK), F.lit(False))


def named_days(text: Column) -> Column:
    """ISO days that the text names in full."""
    found = F.filter(F.array(*[F.when(says(text, rf"(?i)\b{w}\b"), i) for i, w in enumerate(DAY_WORDS, 1)]), lambda d: d.isNotNull())
    return F.when(F.lower(text).contains("day"), found).otherwise(F.array().cast("array<int>"))


def machine_text(text: Column) -> Column:
    """Code rather than prose, by spaces and brackets in the first 3,000 characters; short texts never."""
    s = F.substring(text, 1, 3000)
    n = F.length(s)
    return F.coalesce((n >= 200) & ((F.regexp_count(s, F.lit(" ")) / n < 0.08) | (F.regexp_count(s, F.lit(r"[{}\[\]=;|/\\_]")) / n > 0.08)), F.lit(False))
