"""Functions over stated inputs: what must come out of each."""

import pytest
from pyspark.sql import functions as F

from almanac.functions import geo, names, pages, signals, urls, weekly
from almanac.operators import gates, review

CASES = {}


def cases(name, expression, *pairs):
    CASES[name] = (expression, pairs)


cases("f2_change_slug", names.change_slug, ("Joe's “Bar” & Grill!", "joes-bar-grill"), ("---", "venue"), ("Ab", "ab"))
cases("f2_area_slug", names.area_slug, ("St. Johns!", "st-johns-"), ("North End", "north-end"))
cases("f4_without_promo", names.without_promo, ("Joe's (Now Open!)", "Joe's"), ("Bar [World Cup] – ", "Bar"), ("Pub (East)", "Pub (East)"), ("(Best of 2024)", "(Best of 2024)"))
cases("f7_names_match", lambda c: names.names_match(c, F.lit("The Blue Moon Tavern")), ("Blue Moon", True), ("Blue Moon Tavern & Grill", True), ("Red Sun", False), ("The Bar", False))
cases("f8_synonym_keys", lambda c: F.array_join(names.synonym_keys(c, F.lit("Oakdale")), ","), ("Oakdale Village", "oakdalevillage,oakdale,village"), ("The Village", "thevillage"), ("North Oakdale", "northoakdale,north"), ("St. Mary St", "saintmarystreet"))
cases("f11_menu_host", lambda c: urls.under(urls.host(c), urls.MENU_HOSTS), ("https://img1.wsimg.com/x", True), ("https://notwsimg.com/", False), ("nothing", False))
cases("f12_denied_source", urls.denied_source, ("https://www.sirved.com/a", True), ("xx sirved xx", True), ("https://own.com", False))
cases("f13_url_score", urls.url_score, ("https://a.com/Happy%20Hour+menu.pdf", 110), ("https://a.com/happy_hour", 100), ("/specials", 70), ("/drink-menu", 60), ("/food_menu", 40), ("/menu", 30), ("/menus2", 0), ("/%zz/menu", 30))
cases("f14_menu_document", urls.menu_document, ("https://a.com/nudo_menu.png", True), ("https://a.com/team.png", False))
cases("f16_stale_dated", lambda c: urls.stale_dated(c, F.lit(2024)), ("https://a.com/uploads/2022/x.png", True), ("https://a.com/2022/2023/x", False), ("https://a.com/x20221", False), ("nope", False))
cases("f18_site_kind", urls.site_kind, ("", "none"), ("https://www.facebook.com/x", "social_only"), ("https://own.com", "real"), (None, "none"))
cases("f19_bot_wall", pages.bot_wall, ("Just a moment...", True), ("hello", False), (None, False))
cases("f19_parked_html", signals.parked_html, ("<b>This domain is PARKED</b>", True), ("bodisXcom", False))
cases("f19_squatter", signals.squatter, ("Find Restaurants Near You", True), ("x", False))
cases("f20_signal_links", lambda c: F.array_join(pages.signal_links(c, F.lit("https://a.com/x/y")), " "), ('<a href="/menu">x</a><a href="z">Our <b>Specials</b></a><a href="//b.com/q">no</a><a class=c href=\'/menu\'>again</a>', "https://a.com/menu https://a.com/x/z"), ("none", ""))
cases("f20_offer_links", lambda c: F.array_join(pages.offer_links(c, F.lit("https://a.com")), " "), ('<a href="hh.pdf">Happy-Hour</a><a href="/menu">menu</a>', "https://a.com/hh.pdf"))
cases("f20_page_routes", lambda c: F.array_join(pages.page_routes(c, F.lit("https://a.com/q")), " "), ('{"pageUriSEO":"home"},{"pageUriSEO":"/specials"},{"pageUriSEO":"specials"}', "https://a.com/specials"))
cases("f20_menu_embeds", lambda c: F.array_join(pages.menu_embeds(c, F.lit("https://a.com")), " "), ('<iframe src="https://x.popmenu.com/a_modal"></iframe><iframe data-src="https://order.toasttab.com/b?x=1&amp;y=2">', "https://order.toasttab.com/b?x=1&y=2"), ('<iframe src="https://x.popmenu.com/a_modal">', "https://x.popmenu.com/a_modal"))
cases("f21_full_image", pages.full_image, ("https://static.wixstatic.com/media/ab.png/v1/fill/w_10/x.png", "https://static.wixstatic.com/media/ab.png"), ("https://images.squarespace-cdn.com/a.jpg?format=2500w", "https://images.squarespace-cdn.com/a.jpg?format=1500w"), ("https://images.squarespace-cdn.com/a.jpg", "https://images.squarespace-cdn.com/a.jpg?format=1500w"), ("https://images.squarespace-cdn.com/a.jpg?format=750w", "https://images.squarespace-cdn.com/a.jpg?format=750w"), ("https://a.com/x.png", "https://a.com/x.png"))
cases("f22_guesses", lambda c: F.size(urls.guesses(c, c)), ("https://a.com/x", 13), ("https://tapas.com", 17))
cases("f23_stripped", pages.stripped, ("<head>x</head><h1>T</h1><p>a &amp; b</p><script>q</script><br>c&nbsp;d<!-- z -->", "## T\na & b\n\nc d"), ("&amp;lt;", "&lt;"))
cases("f24_script_text", pages.script_text, ('<script>var a={"note":"<p>Happy Hour 3-6pm</p>","id":"x-1"}</script><script src="q">"menu special"</script>', "Happy Hour 3-6pm"), ("no", ""))
cases("f25_script_menu", lambda c: F.array_join(F.transform(pages.script_menu(c), lambda x: F.concat_ws("|", x["title"], x["name"], x["price"])), ";"), ('{"title":"Bar","items":[{"name":"Ale","price":"$$5"},{"name":"Pie","price":"ask"}]}', "Bar|Ale|$5;Bar|Pie"), ("{}", ""))
cases("f26_linked_menu", lambda c: F.array_join(F.transform(pages.linked_menu(c), lambda x: F.concat_ws("|", x["section"], x["offer_hour"].cast("string"), x["name"], x["cents"].cast("string"))), ";"), ('<script type="application/ld+json">{"name":"Happy Hour","hasMenuSection":[{"name":"Beer","hasMenuItem":[{"name":"IPA","offers":{"price":"$5.50"}},{"name":" "}]}]}</script>', "Beer|true|IPA|550"), ("<script type='application/ld+json'>{broken</script>", ""))
cases("f27_site_map", lambda c: F.array_join(urls.site_map(c), " "), ("<urlset><url><loc> https://a.com/x?a=1&amp;b=2 </loc></url><loc>b</loc>", "https://a.com/x?a=1&b=2 b"))
cases("f28_robots_block", lambda c: pages.robots_block(c, "OurBot", F.lit("/private/x")), ("User-agent: *\nDisallow: /private", True), ("User-agent: other\nDisallow: /", False), ("User-agent: ourbot # us\nDisallow:\nDisallow: /priv # p", True), ("Disallow: /private", False))
cases("f29_image_type", lambda c: pages.image_type(F.unhex(c)), ("FFD8FFE0", "image/jpeg"), ("89504E470D0A", "image/png"), ("4749463839", "image/gif"), ("524946460000000057454250", "image/webp"), ("3C737667", None))
cases("f30_source_kind", urls.source_kind, ("https://a.com/uploads/evidence/1", "reader-photo"), ("https://a.com/x.PDF?y", "pdf"), ("https://a.com/x.jpeg#z", "image"), ("https://a.com/", "page"))
cases("f33_paths", lambda c: urls.venue_path(F.lit("WA"), F.lit("tacoma"), c), ("joes", "/wa/tacoma/venue/joes"))
cases("f35_offer_names", lambda c: F.concat_ws("|", gates.offer_name_key(c), gates.without_price(c, F.lit(500)), gates.heading(c).cast("string"), gates.stored_offer_action(c, F.lit(500))), ("$5  Draft  Beer", "draft beer|Draft  Beer|false|rename"), ("$2 off wells", "wells|$2 off wells|false|keep"), ("Happy Hour Menu", "happy hour menu|Happy Hour Menu|true|keep"), ("$5 Happy hour", "happy hour|Happy hour|false|drop"))
cases("f36_named_days", lambda c: F.concat_ws("|", F.array_join(F.transform(signals.named_days(c), lambda x: x.cast("string")), ","), signals.food_as_drink(c).cast("string")), ("Taco Tuesdays", "2|true"), ("wine on Friday and Sunday", "5,7|false"), ("x", "|false"))
cases("f37_alcohol_content", signals.alcohol_content, ("Full Bar & patio", True), ("for the sake of it", False), ("Must be 21", True), ("tea", False))
cases("f38_alcohol_signal", lambda c: names.alcohol_signal(c, F.lit("restaurant"), F.array().cast("array<string>")), ("Tom's Brewhouse", True), ("The Wine Bar", True), ("Bob's Diner", False), ("Beer & Bun", True))
cases("f39_formats", lambda c: F.concat_ws(",", names.denied_chain(c).cast("string"), names.offer_chain(c).cast("string"), names.no_offer_format(c, F.lit(None).cast("string")).cast("string"), names.bowling(c, F.lit(None).cast("string"), F.array().cast("array<string>")).cast("string")), ("McDonald's", "true,false,false,false"), ("Chili's Grill", "false,true,false,false"), ("Elks 1234", "false,false,true,false"), ("Star Lanes", "false,false,false,true"), ("Truckee Inn", "false,false,false,false"))
cases("f40_place_type", lambda c: F.concat_ws("|", names.place_type(F.lit(None).cast("string"), F.array().cast("array<string>"), c), names.type_label(names.place_type(F.lit(None).cast("string"), F.array().cast("array<string>"), c))), ("Joe's Sports Bar", "sports_bar|Sports Bar"), ("Café Uno", "cafe|Café"), ("Zed", "restaurant|Restaurant"), ("Old Ale House", "pub|Pub"))
cases("f43_leading_array", pages.leading_array, ('noise [1, "a]b", [2]] tail', '[1, "a]b", [2]]'), ("none", None), ("[1,", None))
cases("f46_fetch_key", urls.fetch_key, ("https://www.a.com/x/#y", "a.com/x"), ("HTTP://a.com", "a.com"))
cases("f50_state_names", names.state_name, ("wa", "Washington"), (" PR ", "Puerto Rico"), ("ZZ", "ZZ"))
cases("t10_normalised_times", weekly.normalise_time, ("5pm", 1020), ("5:30 p.m.", 1050), ("17:00", 1020), ("17", 1020), ("noon", 720), ("12am", 0), ("13pm", None), ("25", None), ("x", None))
cases("t22_likelihood", lambda c: names.likelihood(F.lit("bakery"), F.array().cast("array<string>"), c), ("Sweet", 0.0), ("Sweet Tavern", 0.58), ("Cocktail Loaf", 0.41))
cases("c12_suspect_provenance", lambda c: urls.suspect_provenance(c, F.lit("https://www.own.co.uk")), ("https://menu.own.co.uk/x", False), ("https://other.co.uk", True), ("https://yelp.com/a", True), ("https://cdn.cloudfront.net/a", False), (None, False))
cases("c19_first_party", lambda c: urls.first_party(c, F.lit("https://own.com")), ("https://menu.own.com/x", True), ("https://notown.com", False), ("nope", False))
cases("x23_distances", lambda c: geo.format_distance(c.cast("double")), ("0.05", "< 0.1 mi"), ("2.345", "2.3 mi"), ("12.6", "13 mi"))
cases("f31_public_note", review.public_note, (" Dine-in only ", "Dine-in only"), ("great vibes", None), ("21+ after 9", "21+ after 9"), (None, None))
cases("f41_area_of_address", lambda c: review.area_of_address(F.array(F.struct(c.alias("text"), F.array(F.lit("sublocality")).alias("types"))), F.lit("Tacoma")), ("North  End", "North End"), ("tacoma", None), ("Parking Lot", None))
cases("f45_url_variants", lambda c: F.array_join(review.url_variants(c), " "), ("https://a.com/x?y", "https://www.a.com/x?y http://a.com/x?y http://www.a.com/x?y"), ("http://www.a.com", "https://www.a.com/ https://a.com/ http://a.com/"), ("nope", ""))
cases("f49_popmenu_routes", lambda c: F.array_join(review.popmenu_routes(c, F.lit("https://a.com/z")), " "), ('x "/menus/web-happy-hour?location=1" /menus/web-dinner?l=1 https://b.com/menus/web-happy?x=1', "https://a.com/menus/web-happy-hour?location=1"))
cases("c29_source_class", lambda c: review.source_class(c, F.lit("https://www.own.com")), ("https://sirved.com/x", "denylisted_aggregator"), ("junk", "third_party"), ("https://m.facebook.com/x", "social"), ("https://own.com/y", "own"), ("https://menu.own.com", "own_subdomain"), ("https://other.com", "third_party"))
cases("c30_consent_wall", review.consent_wall, ("Manage your consent here", True), ("menu", False), (None, False))
cases("c30_wants_browser", lambda c: review.wants_browser(F.lit(True), F.lit(200), F.lit(False), F.lit(False), c, F.lit(0)), ("tiny shell", True), ("Daily specials", False), ("", True), ("prose " * 200, False), ("{}[]=;" * 60, True))
cases("c30_wants_anti_bot", lambda c: review.wants_anti_bot(F.lit(True), F.lit(200), F.lit(False), F.lit(False), c, F.lit(0)), ("Just a moment", True), ("$5 beer", False), (None, True))
cases("c21_render_escalation", lambda c: review.render_escalation(F.array(F.lit("https://a.com/happy-hour/")), F.array(c), F.array(F.lit(0))), ("https://a.com/happy-hour", "hh_page_no_offerings"), ("https://a.com/", "unread_hh_page"))
cases("c21_escalation_route", lambda c: review.escalation_route(c.cast("int"), F.lit(False), F.array(F.struct(F.lit(False).alias("suspect"), F.lit(0).alias("n_offers")))), ("0", "skip"), ("2", "paid"))
cases("g12_recognisability", lambda c: F.concat_ws("|", geo.recognisability(c, F.lit(None).cast("string"), F.lit(None).cast("string")).cast("string"), geo.place_tier(c)), ("suburb", "1|coarse"), ("quarter", "1|fine"), ("hamlet", "0|fine"))
cases("c13_dead_end", lambda c: F.concat_ws("|", gates.dead_end(F.lit(False), F.lit(None).cast("boolean"), c, F.lit("restaurant"), F.array().cast("array<string>")).cast("string"), gates.dead_end(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), c, F.lit("restaurant"), F.array().cast("array<string>")).cast("string")), ("Noodle House", "true|false"), ("Noodle Tavern", "false|false"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_stated_outputs(spark, name):
    expression, pairs = CASES[name]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(pairs)], "k int, input string").coalesce(1)
    assert [r.output for r in df.select("k", expression(F.col("input")).alias("output")).orderBy("k").collect()] == [b for _, b in pairs]


def test_words_end_at_accented_letters(spark):
    df = spark.createDataFrame([("éapps",), ("apps",), ("xapps",)], "t string")
    assert [r[0] for r in df.coalesce(1).select(signals.food_as_drink(F.col("t"))).collect()] == [True, True, False]
