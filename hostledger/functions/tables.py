"""Fixed values the URL rules compare against, and the few tables built from a rule."""

from __future__ import annotations


from pyspark.sql import SparkSession

# Query parameters dropped as tracking noise.
TRACKING_PARAMS = (
    "utm_source utm_medium utm_campaign utm_term utm_content "
    "fbclid gclid msclkid _ga _gl mc_cid mc_eid "
    "ref referrer campaign source medium"
).split()

# Extra parameters dropped by default.
CUSTOM_STRIP_PARAMS = "utm_source utm_medium utm_campaign fbclid gclid".split()

# Parameters that do not take part in a URL pattern.
IGNORED_PARAMS = "tid fid page id p offset limit".split()

# Public suffixes of two labels.
TWO_PART_SUFFIXES = (
    "co.uk com.au com.sg com.cn org.uk gov.uk ac.uk net.au com.br com.mx"
).split()

# File extensions outside the crawl scope.
DISALLOWED_EXTENSIONS = [".js", ".txt", ".css", ".xml"]

# Href prefixes that never lead to a page.
SKIPPED_PREFIXES = ["data:", "mailto:", "tel:", "javascript:"]

# Path fragments that mark a link loop.
REPEATED_FRAGMENTS = ["/js/js/", "/css/css/", "/img/img/", "/static/static/", "/assets/assets/"]
RECURSIVE_FRAGMENTS = ["/../../../", "/./././", "/./../"]
RECURSIVE_FRAGMENTS_STRICT = RECURSIVE_FRAGMENTS + ["/../../"]

# Phrases of a cancelled run.
CANCEL_PHRASES = [
    "context canceled",
    "context deadline exceeded",
    "operation interrupted",
    "cancelled",
    "canceled",
]

# Segment prefixes that look like a session id.
SESSION_PREFIXES = "sid session token auth key id uid ref".split()

# Fragment keys whose value varies.
VARIABLE_FRAGMENT_KEYS = "id page p offset limit n t v ref from".split()

# Locale words of the preprocessing rules.
COMMON_LOCALES = (
    "en es fr de it pt ru ja ko zh "
    "ar hi tr pl nl sv da no fi cs "
    "hu ro bg hr sk sl et lv lt mt "
    "en-us en-gb en-ca en-au es-es es-mx fr-fr "
    "fr-ca de-de de-at de-ch it-it pt-pt pt-br "
    "zh-cn zh-tw zh-hk ja-jp ko-kr"
).split()
SPECIAL_LOCALE_WORDS = (
    "root default international worldwide global int www web mobile m api app"
).split()

# Two-letter language codes of the preprocessing rules.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo "
    "br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es "
    "et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr "
    "ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj "
    "kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv "
    "ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd "
    "se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti "
    "tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi "
    "yo za zh zu"
).split()

# Two-letter language codes of the crawl rules.
CRAWL_LANGUAGES = (
    "en de fr es it pt nl ru ja ko zh ar tr pl cs hu fi da "
    "sv no el he th vi id ms hi bn ur fa uk bg hr sk sl et "
    "lv lt ro sr mk sq is mt ga cy eu ca gl oc co br gd "
    "kw gv fo nn nb se be kk ky uz tk mn bo my km lo si ta "
    "te kn ml or gu pa as ne dz am ti om so sw rw rn ny sn "
    "st tn ts ss ve xh zu af yo ig ha ff wo bm ee tw ak "
    "lg ln kg sg za nd nr lb sa"
).split()

# Country codes of the crawl rules.
CRAWL_COUNTRIES = (
    "us gb ca au de fr es it pt nl be at ch dk se no fi is "
    "ie pl cz sk hu si hr ba rs me mk al bg ro md ua by ru "
    "lt lv ee jp kr cn tw hk mo sg my th vn ph id bn mm kh "
    "la in pk af ir iq sy lb jo il ps sa ye om ae qa bh kw "
    "tr cy ge am az kz kg tj tm uz mn np bt lk mv eg ly sd "
    "tn dz ma mr ml bf ne td ng cm cf gq ga cg cd ao zm mw "
    "mz mg mu sc km dj so et er ke ug tz rw bi za bw na sz "
    "ls zw br ar uy py bo pe ec co ve gy sr gf cl mx gt bz "
    "sv hn ni cr pa cu jm ht do pr vi ag dm lc vc gd bb tt "
    "aw cw sx bq ms ai kn bs tc vg ky bm lu"
).split()

# Dashed codes of the crawl rules that are no language and country of the two tables above.
CRAWL_DASHED_LOCALES = (
    "jo-ar jo-en ae-ar ae-en sa-ar sa-en kw-ar kw-en qa-ar qa-en bh-ar bh-en om-ar om-en "
    "ye-ar ye-en iq-ar iq-en sy-ar sy-en lb-ar lb-en ps-ar ps-en eg-ar eg-en ly-ar ly-en "
    "sd-ar sd-en tn-ar tn-fr dz-ar dz-fr ma-ar ma-fr mr-ar mr-fr td-ar td-fr dj-ar dj-fr "
    "km-ar km-fr no-bv da-gl ca-ad mt-mt bs-ba tg-tj bn-bd az-az hy-am ka-ge wo-sn ff-gn"
).split()

# Four-letter country-language codes of the crawl rules.
CRAWL_COMPOUND_LOCALES = (
    "chde chfr chit kzkk kzru benl befr bede caen cafr lufr lude lulb inen inhi pken pkur "
    "bden bdbn lken lksi lkta npen npne myen mymy khen khkm laen lalo mmen mmmy mden mdru mdro "
    "uaen uaru uauk byru byen byby kzen kgen kgru kgky tjen tjru tjtg tmen tmru tmtk "
    "uzen uzru uzuz mnen mnru mnmn egen egar tnen tnar tnfr dzen dzar dzfr maen maar mafr "
    "mren mrar mrfr mlen mlfr bfen bffr neen nefr tden tdfr tdar ngen ngha ngig cmen cmfr "
    "cfen cffr gqen gqes gqfr gaen gafr cgen cgfr cden cdfr aoen aopt zmen zmny mwen mwny "
    "mzen mzpt mgen mgfr mgmg muen mufr scen scfr kmen kmar kmfr djen djar djfr soen soar "
    "eten etar etam eren erar erti keen kesw ugen ugsw tzen tzsw rwen rwrw rwfr "
    "bien birn bifr zaen zaaf zazu bwen bwtn naen naaf szen szss lsen lsst zwen zwsn"
).split()


def iso_countries() -> list[str]:
    """All ISO 3166-1 alpha-2 codes in lower case, from the JVM's own table."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a Spark session must be active to read the JVM's country table")
    return sorted(code.lower() for code in spark._jvm.java.util.Locale.getISOCountries())
