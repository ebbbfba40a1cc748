"""Word lists, lookup tables and patterns that results depend on, stated as they are."""

# Base currency of all converted prices.
BASE_CURRENCY = "NOK"

# Quote units of some exchanges: unit -> (main currency, factor).
SUBUNITS = {"GBp": ("GBP", 0.01), "GBX": ("GBP", 0.01), "ZAc": ("ZAR", 0.01), "ILA": ("ILS", 0.01)}

# Domiciles accepted by the tax-favoured account.
ASK_COUNTRIES = ["AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HR", "HU", "IE", "IS", "IT", "LI",
                 "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK"]

# Leveraged and currency-hedged instruments.
EXCLUDE_CATEGORIES = ["Trading Tools"]
EXCLUDE_NAME = r"leverag|\b[2-5]x\b|\(-?[1-5]x\)|short|invers|\bbear\b|\bbull\b"
HEDGED_NAME = r"(?<!tail )hedg|\bhdg\b|\bhgd\b|pfhdg"

# Exchange code of a listing slug -> price symbol suffix; code-list exchange -> suffix, in priority order.
LISTING_SUFFIX = {"xeta": ".DE", "xsto": ".ST", "xcse": ".CO", "xosl": ".OL", "xhel": ".HE", "xetr": ".DE"}
CODE_SUFFIX = {"GY": ".DE", "LN": ".L", "NA": ".AS", "FP": ".PA", "IM": ".MI", "SW": ".SW", "SE": ".SW", "SS": ".ST", "DC": ".CO",
               "NO": ".OL", "FH": ".HE", "BB": ".BR", "SM": ".MC", "AV": ".VI", "ID": ".IR", "GF": ".F", "GS": ".SG", "GM": ".MU",
               "GD": ".DU", "GB": ".BE", "GH": ".HM"}
QUOTE_TYPES = ["ETF", "MUTUALFUND", "EQUITY"]


# ---------------------------------------------------------------------------- classification rules
# Labels and patterns in rule order: the first match wins.

SECTOR_FROM_CATEGORY = {
    "Technology Sector Equity": "Teknologi",
    "Healthcare Sector Equity": "Helse",
    "Financials Sector Equity": "Finans",
    "Energy Sector Equity": "Energi",
    "Industrials Sector Equity": "Industri",
    "Consumer Goods & Services Sector Equity": "Forbruk",
    "Communications Sector Equity": "Kommunikasjon",
    "Utilities Sector Equity": "Forsyning",
    "Real Estate Sector Equity": "Eiendom",
    "Natural Resources Sector Equity": "Råvarer og materialer",
    "Precious Metals Sector Equity": "Edelmetaller (gruver)",
    "Infrastructure Sector Equity": "Infrastruktur",
}

SECTOR_FROM_NAME = [
    (r"health ?care|pharma|biotech|genomic|medical|healthcare|bio ?revolution|bionic", "Helse"),
    (r"information tech|\btech(nology)?\b|semiconductor|software|cyber|internet|robot|cloud|quantum|blockchain|metaverse|data cent", "Teknologi"),
    (r"\bbanks?\b|financ|insurance|fintech", "Finans"),
    (r"oil|\bgas\b|energy(?! transition)|uranium|nuclear", "Energi"),
    (r"industrials?\b(?! average)|aerospace|defen[cs]e|transport", "Industri"),
    (r"consumer|retail|luxury|food|agri|beverage", "Forbruk"),
    (r"communication|media|telecom", "Kommunikasjon"),
    (r"utilit|water", "Forsyning"),
    (r"real estate|reit|property|propert", "Eiendom"),
    (r"materials|mining|miners|metals|natural resources|timber|lithium", "Råvarer og materialer"),
    (r"infrastructure", "Infrastruktur"),
    (r"private equity", "Private equity"),
]

THEMES = [
    (r"biotech|genomic|bio ?revolution", "Biotek"),
    (r"medical device|medtech|healthcare innovation|digital health|telemedicine|bionic|health ?tech", "Medisinsk teknologi"),
    (r"semiconductor|\bchips?\b|memory|photonic", "Halvledere"),
    (r"cyber ?security|cyber", "Cybersikkerhet"),
    (r"quantum", "Kvantedata"),
    (r"^(?!.*(enhanced|optimi[sz]ed)).*(\bai\b|artificial intelligence|machine learning)", "Kunstig intelligens"),
    (r"robot|automation|humanoid|drone", "Robotikk og automatisering"),
    (r"cloud|data cent|software|saas|internet|e-?commerce|digital (econ|transf|infra)", "Sky, programvare og internett"),
    (r"blockchain|bitcoin|crypto|digital assets", "Blokkjede og krypto"),
    (r"defen[cs]e|aerospace|military", "Forsvar"),
    (r"\bspace\b|new space", "Romfart"),
    (r"uranium|nuclear", "Uran og kjernekraft"),
    (r"hydrogen", "Hydrogen"),
    (r"clean energy|renewable|solar|wind|cleantech|clean tech|new energy|alternative energy|energy transition|green energy", "Ren energi"),
    (r"battery|lithium|electric vehicle|\bev\b|mobility|autonomous", "Batteri og elbil"),
    (r"water", "Vann"),
    (r"food|agri|agtech", "Mat og landbruk"),
    (r"gaming|esports|metaverse|entertainment", "Spill og underholdning"),
    (r"fintech|digital payment|payments", "Fintech"),
    (r"gold miner|gold producer|junior gold|silver miner|precious metal", "Gull- og sølvgruver"),
    (r"ageing|aging|longevity|demograph", "Aldrende befolkning"),
    (r"luxury", "Luksus"),
    (r"\bbanks?\b", "Banker"),
    (r"oil|\bgas\b", "Olje og gass"),
    (r"innovation|megatrend|disrupt|future|next gen|transformational", "Innovasjon og megatrender"),
]

STYLES = [
    (r"premium income|covered call|option income|buy ?write|yieldmax|income & growth", "Opsjonsinntekt"),
    (r"equal weight|equal-weight|\bew\b", "Likevektet"),
    (r"min(imum)? ?vol|low vol", "Lav volatilitet"),
    (r"multi-?factor|factor", "Multifaktor"),
    (r"momentum", "Momentum"),
    (r"quality", "Kvalitet"),
    (r"dividend|high yield equity|income|aristocrat", "Utbytte"),
    (r"\bvalue\b", "Verdi"),
    (r"\bgrowth\b", "Vekst"),
    (r"small ?cap|small-cap|smallcap|mid ?cap|mid-cap|midcap|small & mid|\bsmid\b|\bmid\b|\bsmall\b", "Små/mellomstore"),
    (r"\bactive\b|enhanced|research enhanced", "Aktiv"),
]
STYLE_FROM_CATEGORY = [(r"Growth", "Vekst"), (r"Value", "Verdi"), (r"Mid/Small|Small Cap|Mid Cap", "Små/mellomstore")]

ESG = (r"\besg\b|\bsri\b|paris|\bpab\b|\bctb\b|climate|sustainab|screened|responsible|esg leaders|transition|low carbon|"
       r"ex fossil|fossil fuel|\bsdg\b|green|impact")

REGION_FROM_CATEGORY = {
    "Global Equity Large Cap": "Global", "Global Equity Mid/Small Cap": "Global", "Global Fixed Income": "Global",
    "Europe Equity Large Cap": "Europa", "Europe Equity Mid/Small Cap": "Europa", "Europe Fixed Income": "Europa",
    "Euro Money Market": "Europa",
    "US Equity Large Cap Blend": "USA", "US Equity Large Cap Growth": "USA", "US Equity Large Cap Value": "USA",
    "US Equity Small Cap": "USA", "US Equity Mid Cap": "USA", "US Fixed Income": "USA",
    "UK Equity Large Cap": "UK", "UK Equity Mid/Small Cap": "UK", "Sterling Fixed Income": "UK",
    "Japan Equity": "Japan", "Japan Fixed Income": "Japan",
    "Global Emerging Markets Equity": "Fremvoksende", "Emerging Markets Fixed Income": "Fremvoksende",
    "Europe Emerging Markets Equity": "Fremvoksende",
    "Asia ex-Japan Equity": "Asia", "Asia Equity": "Asia", "Asia Fixed Income": "Asia",
    "Greater China Equity": "Kina", "India Equity": "India", "India Fixed Income": "India",
    "Korea Equity": "Korea", "Latin America Equity": "Latin-Amerika", "Mexico Equity": "Latin-Amerika",
    "Africa Equity": "Midtøsten og Afrika", "Thailand Equity": "Asia",
    "Australia & New Zealand Equity": "Australia/NZ", "Australia & New Zealand Fixed Income": "Australia/NZ",
    "Canadian Equity Large Cap": "Canada",
}

REGION_FROM_NAME = [
    (r"emerging|\bem\b|frontier", "Fremvoksende"),
    (r"nordic|norway|norge|\bobx\b|sweden|omx|denmark|finland", "Norden"),
    (r"ex[- ]?(usa?|u\.s\.)\b", "Global"),
    (r"ex[- ]?japan", "Asia"),
    (r"indo-?pac", "Asia"),
    (r"europe.*ex[- ]?uk", "Europa"),
    (r"(?<!ex-)(?<!ex )china|chinese|hang seng|\bcsi\b", "Kina"),
    (r"india|nifty", "India"),
    (r"korea", "Korea"),
    (r"taiwan", "Taiwan"),
    (r"japan|topix|nikkei", "Japan"),
    (r"saudi|turkey|pakistan|israel|middle east|africa|gcc|uae|qatar|kuwait", "Midtøsten og Afrika"),
    (r"brazil|\blatin|mexico|\bchile\b|argentin", "Latin-Amerika"),
    (r"asia|pacific|asean|vietnam|indonesia|thailand|singapore|malaysia|philippin", "Asia"),
    (r"\buk\b|ftse 100|ftse 250|united kingdom|britain|gilt|sterling", "UK"),
    (r"canada|canadian|tsx", "Canada"),
    (r"australia", "Australia/NZ"),
    (r"world|global|acwi|all[- ]world|all country|international|\bgbl\b", "Global"),
    (r"europe|euro ?stoxx|stoxx 600|\bemu\b|eurozone|euro area|germany|\bdax\b|france|\bcac\b|"
     r"italy|spain|ibex|netherlands|switzerland|\bsmi\b|greece|poland|austria|belgium|portugal|ireland", "Europa"),
    (r"s&p ?500|\busa?\b|u\.s\.|nasdaq|russell|dow jones (us|industrial)|america|\bspdr s&p\b|\bselect sector\b", "USA"),
]

BOND_SEGMENTS = [
    (r"high yield|\bhy\b|fallen angel", "High yield"),
    (r"inflation|linker|\btips\b|\bilb\b", "Inflasjonssikret"),
    (r"corporate|corp\b|\bcorp |credit|\bibonds?\b.*corp", "Selskapsobligasjoner"),
    (r"treasury|treasuries|government|govt|gilt|bund|sovereign|\bbtp\b|\boat\b|state|t-bill|bills", "Statsobligasjoner"),
    (r"covered|pfandbrief", "OMF/covered bonds"),
    (r"floating|frn|float", "Flytende rente"),
    (r"aggregate|\bagg\b|core bond|broad|universal", "Bred rente"),
]

INDEX_NAME = r"\bind(?:e)?ks\b|\bindex\b|\bindeks"

# Issuer names and noise words left out when names are compared.
ISSUERS = ["ishares", "xtrackers", "amundi", "lyxor", "vanguard", "spdr", "invesco", "wisdomtree",
           "hsbc", "ubs", "franklin", "jpmorgan", "j.p. morgan", "l&g", "legal & general", "vaneck",
           "global x", "hanetf", "deka", "bnp paribas easy", "bnp", "xact", "fidelity", "pimco",
           "ossiam", "first trust", "dws", "db x-trackers", "comstage", "expat", "kraneshares",
           "rize", "tabula", "goldman sachs", "abrdn", "nomura", "ark", "blackrock"]
NAME_NOISE = (r"\b(ucits|etf|acc|accumulating|accumulation|dist|distributing|distribution|inc|"
              r"usd|eur|gbp|chf|sek|nok|jpy|dr|swap|ii|iii|iv|v|1c|1d|2c|2d|3c|4c|c|d|a|b|"
              r"shares?|class|fund|plc|sicav|the|of|and|&|-|\(|\))\b")

# Fields of a record: leaf names, and candidate leaf keys per column in order of preference (fixed values).
INFO_FIELDS = ["name", "long_name", "symbol", "isin", "currency", "price_unit", "clearing_place", "issuer_name",
               "instrument_type", "instrument_group_type", "is_tradable", "is_monthly_saveable", "is_shortable"]
FIELD_CANDIDATES = {
    "fee": ["fund_yearly_fee", "fund_calculated_fee"], "total_fee": ["fund_total_fee"], "category": ["fund_category"],
    "fund_type": ["fund_type"], "number_of_owners": ["number_of_owners"], "dividend_policy": ["fund_dividend_strategy"],
    "risk": ["fund_raw_risk"], "rating": ["fund_ms_rating"], "fund_size": ["fund_total_market_value"],
    "start_date": ["fund_start_date"], "exchange_country": ["exchange_country"], "price": ["last.price", "close.price"],
    "spread_pct": ["spread_pct"], "turnover": ["turnover_normalized"], "yield_1y": ["yield_1y"], "yield_3y": ["yield_3y"],
    "yield_5y": ["yield_5y"], "yield_10y": ["yield_10y"]}
NUMERIC = ["fee", "total_fee", "number_of_owners", "fund_size", "price", "spread_pct", "turnover", "yield_1y", "yield_3y",
           "yield_5y", "yield_10y", "rating", "risk"]
ISIN = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
WRAPPER_KEYS = ["value", "decimals", "currency", "unit"]
RISK_PERIODS = {1: "oneYear", 3: "threeYears", 5: "fiveYears"}
