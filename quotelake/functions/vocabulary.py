"""Rule data of the domain: ordered patterns, names, thresholds. Order matters: the first match wins.

Everything here is a fixed value: labels, patterns and limits that results must agree on. Patterns are matched without regard to case,
with Unicode word borders.
"""

from __future__ import annotations

I = "(?iu)"  # noqa: E741
NUMBER = r"\d{1,3}(?:[.,]\d{1,5})?"

# Channels.
CHANNELS = (
    ("swift", r"\bswift\b|\bmt\d{3}\b"),
    ("curier_posta", r"curier|po[șs]t[ăa](?!\s+electronic)|expediere|transmitere\s+la\s+adres|adresa\s+indicat"),
    ("hartie", r"suport\s+de\s+h[âa]rtie|pe\s+h[âa]rtie|tip[ăa]rit"),
    ("email", r"e-?mail|po[șs]t[ăa]\s+electronic"),
    ("atm", r"\bATM\b|\bMFM\b|bancomat|ma[șs]in[ăai]\s+multifunc[țt]"),
    ("pos", r"\bPOS\b|imprinter|\bEPOS\b"),
    ("internet_banking", r"internet\s*banking|\bibank\w*|online|aplica[țt]i|\be-?banking\b|self\s*bank"),
    ("mobile_banking", r"mobile\s*banking|\bMB@?nk|\bmobil(?!iar)"),
    ("phone_banking", r"phone\s*banking|call\s*cent|care\s*cent|telefon"),
    ("ghiseu", r"ghi[șş]e|casierie|unitate\w*\s+bancar|sucursal|agen[țt]i[ae]"),
)
# Concepts that move money and so have a destination.
WITH_DESTINATION = (
    "transfer_credit", "incasare", "retragere_numerar", "depunere_numerar", "debitare_directa", "plata_programata", "plata_instant", "speze_swift", "tranzactie_card", "documentar",
)
# Destinations.
DESTINATIONS = (
    ("intrabancar", r"intrabancar|[îi]n\s+cadrul\s+b[ăa]ncii|conturi\s+proprii|acela[șs]i\s+prestator"),
    ("sepa", r"\bSEPA\b|zon[ăa]\s+unic[ăa]\s+de\s+pl[ăa][țt]i|zonei\s+unice\s+de\s+pl[ăa]ti|comunitat\w*\s+europe|single\s+euro\s+payment"),
    ("extern", r"extern|str[ăa]in[ăa]tate|interna[țt]ional|[îi]n\s+afara\s+UE|non[\s-]?UE|transfrontalier"),
    ("interbancar", r"interbancar|alt\s+prestator|alte\s+b[ăa]nci|alt[ei]\s+b[ăa]nci"),
    ("ue", r"uniune\w*\s+europe|spa[țt]iul\s+economic|(?<!afara\s)(?<!non-)(?<!non\s)\bUE\s*/?\s*SEE\b|(?<!afara\s)(?<!non-)(?<!non\s)\bUE\b"),
    ("national", r"\bna[țt]ional\w*\b|\bdomestic\w*|[îi]n\s+Rom[âa]nia|din\s+Rom[âa]nia|\bintern[ae]?\b|\blocal\b"),
    ("intrabancar", r"ATM-?ur\w*\s+(?:BCR|Libra|b[ăa]ncii)|POS-?ur\w*\s+(?:BCR|Libra)|ghi[șs]e\w*\s+b[ăa]ncii"),
)
DESTINATION_CHAIN = (("extern", "ue", "sepa"),)
DESTINATION_EXCLUSIVE = ("intrabancar", "interbancar", "sepa", "ue", "extern", "national")
# Products of rates.
PRODUCTS = (
    ("noua_casa", r"noua\s+cas[ăa]|prima\s+cas[ăa]"),
    ("refinantare", r"refinan[țt]"),
    ("credit_auto", r"credit\w*[^.]{0,20}(ma[șs]in|auto\b)|ma[șs]in[ăa]\s+electric"),
    ("credit_magazin", r"credit\w*\s+[îi]n\s+magazin|rate\s+la\s+comercian|cump[ăa]r[ăa]ri\s+[îi]n\s+rate"),
    ("descoperit_cont", r"descoperi[rt]\w*\s+de\s+cont|\boverdraft\b"),
    ("credit_nevoi_personale", r"nevoi\s+personale|credit\w*\s+de\s+consum|credit\w*\s+personal|personal\s+loans?|\bexpresso\b|creditul\s+econom|libra\s+way|creditul\s+t[ăa]u\s+personal"),
    ("credit_ipotecar", r"ipotec|imobiliar|\bhabitat\b|creditul\s+locativ|credit\w*\s+(pentru\s+)?locuin[țt]"),
    ("credit_business", r"credit\w*[^.]{0,25}(investi[țt]ii|dezvolt[ăa]ri)|credit\w*\s+it\b|credite\s+energie"),
    ("leasing", r"\bleasing\b"),
    ("depozit_termen", r"depozit\w*\s+(la\s+termen|bancar|business|plus|simplu|flexi|fresh|cu\s+depuneri)|\bdeposits?\b|depozitul\b|depozite\b"),
    ("cont_economii", r"cont\w*\s+de\s+economii|economisi|\beconomii\b|savings?\b|deschide\s+cont\s+de\s+economii"),
    ("fonduri_investitii", r"fonduri\s+(mutuale|de\s+investi[țt]ii)|investi[țt]ii\s+la\s+burs"),
    ("card_junior", r"card\w*[^.]{0,20}(copii|junior|xteen|\bteen\b)"),
    ("card_salariu", r"card\w*\s+salariu"),
    ("card_cumparaturi", r"card\w*\s+de\s+cump[ăa]r[ăa]turi|card\w*\s+de\s+credit\s*\(\s*cump[ăa]r[ăa]turi"),
    ("card_credit", r"card\w*\s+de\s+credit|carduri\s+de\s+credit|credit\s+cards?"),
    ("card_debit", r"card\w*\s+de\s+debit|debit\s+cards?"),
    ("cont_curent", r"cont\w*\s+curent|current\s+accounts?|cont\s+de\s+pl[ăa][țt]i|pachet\w*\s+(de\s+)?cont|cont\s+bancar|cont\s+imm|business\s+accounts?"),
)
# Segments of rates.
RATE_SEGMENTS = (
    ("pj", r"persoane\s+juridice|\bIMM\b|\bPFA\b|companii|firm[ăa]|firme|business|corporate|profesii\s+liberale|\bSRL\b|for\s+business"),
    ("pf", r"persoane\s+fizice|private\s+individuals"),
)
# Segments in document names; letters may not touch them, marks and digits may.
NAME_SEGMENTS = (
    ("pj", r"(?<![a-z])(pj|imm|pfa|corporate|companii|firme|business)(?![a-z])|persoane[\W_]*juridice"),
    ("pf", r"(?<![a-z])(pf|retail)(?![a-z])|persoane[\W_]*fizice"),
)
# Rates, the value in group 1.
RATES = (
    ("ircc_valoare", rf"IRCC\b[^+%]{{0,70}}?(?:=|:|valoarea\s+de|este|egal\s+cu)\s*({NUMBER})\s*%"),
    ("ircc_valoare", rf"IRCC\b[^+%]{{0,30}}?\d{{2}}\.\d{{2}}\.\d{{4}}\s*({NUMBER})\s*%"),
    ("ircc_valoare", rf"IRCC[^()]{{0,140}}?\(\s*({NUMBER})\s*%\s*\)"),
    ("euribor_valoare", rf"EURIBOR[^()+%]{{0,40}}?\(\s*({NUMBER})\s*%\s*\)"),
    ("euribor_valoare", rf"EURIBOR[^+%]{{0,70}}?(?:=|:|valoarea\s+de|este|egal\s+cu)\s*({NUMBER})\s*%"),
    ("euribor_valoare", rf"EURIBOR\s*(?:\d+\s*(?:luni|M))\s+({NUMBER})\s*%"),
    ("robor_valoare", rf"ROBOR[^+%]{{0,70}}?(?:=|:|valoarea\s+de|este|egal\s+cu)\s*({NUMBER})\s*%"),
    ("marja_ircc", rf"IRCC(?:\s*\d*[MT])?\s*\+\s*({NUMBER})\s*%"),
    ("marja_ircc", rf"({NUMBER})\s*%[\d*]{{0,3}}\s*%?\s*\+\s*IRCC"),
    ("marja_euribor", rf"EURIBOR(?:\s*\d*[MT])?\s*\+\s*({NUMBER})\s*%"),
    ("marja_euribor", rf"({NUMBER})\s*%[\d*]{{0,3}}\s*\+\s*EURIBOR"),
    ("marja_robor", rf"ROBOR(?:\s*\d*[MT])?\s*\+\s*({NUMBER})\s*%"),
    ("marja_ircc", rf"IRCC[^%]{{0,45}}?marj[ăa][^%\d]{{0,12}}({NUMBER})\s*p\.?\s*p\.?"),
    ("marja_euribor", rf"EURIBOR[^%]{{0,45}}?marj[ăa][^%\d]{{0,12}}({NUMBER})\s*p\.?\s*p\.?"),
    ("marja_fixa", rf"\+\s*({NUMBER})\s*%\s*marj[ăa]"),
    ("marja_fixa", rf"marj[ăa]\s+fix[ăa][^%\d]{{0,30}}?({NUMBER})\s*%"),
    ("dae", rf"\bDAE\d?\b[^%]{{0,45}}?({NUMBER})\s*%"),
    ("dae", rf"dob[âa]nd[ăa]\s+anual[ăa]\s+efectiv[ăa][^%]{{0,40}}?({NUMBER})\s*%"),
    ("dae", rf"({NUMBER})\s*%\s*DAE"),
    ("cashback", rf"({NUMBER})\s*%\s*cashback"),
    ("cashback", rf"cashback[^%]{{0,25}}?({NUMBER})\s*%"),
    ("comision_procent", rf"comision[^%]{{0,120}}?({NUMBER})\s*%\s*p\.?\s*a\b"),
    ("comision_procent", rf"comision[^%]{{0,45}}?({NUMBER})\s*%"),
    ("comision_procent", rf"({NUMBER})\s*%\s*comision"),
    ("comision_procent", rf"({NUMBER})\s*%\s*tax[ăa]"),
    ("comision_procent", rf"tax[ăa][^%]{{0,35}}?({NUMBER})\s*%"),
    ("nominala", rf"dob[âa]nd[ăa][^%]{{0,85}}?({NUMBER})\s*%"),
    ("nominala", rf"rat[ăa]\s+(?:\w+\s+){{0,2}}(?:a\s+)?dob[âa]nzii[^%]{{0,45}}?({NUMBER})\s*%"),
    ("nominala", rf"({NUMBER})\s*%\s*(?:p\.?\s*a\.?\s*)?dob[âa]nd"),
    ("nominala", rf"rat[ăa]\s+fix[ăa][^%]{{0,25}}?({NUMBER})\s*%"),
    ("nominala", rf"({NUMBER})\s*%\s*(?:p\.?\s*a\b|per\s+annum)"),
    ("nominala", rf"({NUMBER})\s*%\s*APY\b"),
    ("nominala", rf"interest[^%]{{0,30}}?({NUMBER})\s*%"),
    ("comision_procent", rf"fee[^%]{{0,30}}?({NUMBER})\s*%"),
    ("comision_procent", rf"({NUMBER})\s*%\s*fee"),
)
# Words and marks that a pattern of RATES can't do without wherever they stand in it; marks as they are written in patterns.
RATE_WORDS = ("ircc", "euribor", "robor", "marj", "dae", "efectiv", "cashback", "comision", "tax", "dob", "rat", "fix", "apy", "interest", "fee")
RATE_MARKS = {r"\s*%": "%", r"\+": "+", r"\(": "(", r"\.\d": "."}
# What follows the percentage that a pattern of RATES begins with.
AFTER_PERCENT = r"%[\d*]{0,3}\s*%?\s*[+dctpaf]"
# Letters for which small letters and patterns without regard to case disagree: what patterns take for i, s and k, and two that only newer tables of Unicode know.
ODD_LETTERS = ("\u0130", "\u0131", "\u017f", "\u212a", "\ua7cb", "\ua7dc")
# Lines with these hold percentages that are no rates.
NO_RATES = (
    r"avans", r"din\s+(?:dob[âa]nda\s+)?brut", r"impozit", r"discount|reducere\s+(?:de|la)\s+dob|\d+[.,]?\d*\s*%\s*reducere", r"[îi]ndator", r"\bTVA\b", r"100\s*%\s*on",
    r"din\s+(?:pre[țt]ul|valoarea|suma)", r"\bLTV\b", r"subven[țt]i", r"\bLIBOR\b", r"rat[ăa]\s+de\s+garantare|garantare:", r"cifra\s+de\s+afaceri", r"puncte\s+bonus",
    r"din\s+dob[âa]nda\s+acumulat|din\s+soldul", r"rat[ăa]\s+Lombard|a\s+cotat", r"marj[ăa][^.]{0,40}(?:curs|schimb\s+valutar)", r"conversie\s+valutar",
    r"recupereze|ajutor\s+de\s+stat|\bgrant", r"retrager[ei][^.]{0,30}limita|o\s+singur[ăa]\s+retragere",
)
# Of these, one at least stands in every line that NO_RATES match.
NO_RATES_WORDS = (
    "avans", "din", "impozit", "discount", "reducere", "ndator", "tva", "100", "ltv", "subven", "libor", "garantare", "cifra", "puncte", "lombard", "cotat", "marj", "conversie",
    "recupereze", "ajutor", "grant", "retrager",
)
# Instalments without interest; the number of instalments in group 1 where there is one.
INSTALMENTS = (
    r"(\d{1,2})\s*(?:de\s+)?rate[^.%]{0,25}?0\s*%\s*dob", r"(\d{1,2})\s*(?:de\s+)?rate\s*(?:lunare\s*)?f[ăa]r[ăa]\s*dob", r"(\d{1,2})\s*(?:monthly\s+)?instal?ments?[^.%]{0,20}?0\s*%",
    r"()0\s*%\s*dob[âa]nd[ăa]?[^.]{0,30}?\brate\b", r"()\brate\s+f[ăa]r[ăa]\s+dob[âa]nd", r"()interest[- ]free\s+instal?ments?",
)
INSTALMENTS_WORDS = ("rate", "instal")
# Words that begin another measure in a table row.
NEW_LABEL = r"dob[âa]nd|comision|tax[ăa]|\bDAE\b|IRCC|EURIBOR|ROBOR|marj|cashback|\bfee\b|interest|\bAPY\b|avans|\bLTV\b"
# Plausible intervals of rates.
INTERVALS = {
    "nominala": (0.0, 40.0), "dae": (0.0, 50.0), "marja_ircc": (0.1, 20.0), "marja_euribor": (0.1, 20.0), "marja_robor": (0.1, 20.0), "marja_fixa": (0.1, 20.0),
    "ircc_valoare": (4.0, 8.0), "robor_valoare": (4.0, 9.0), "euribor_valoare": (1.5, 5.0), "cashback": (0.0, 10.0), "comision_procent": (0.0, 10.0), "rate_fara_dobanda": (0.0, 0.0),
}
# Plausibility by unit and category.
LIMITS = {"suma": 10_000.0, "depozite": 12.0, "credite": 30.0, "conturi_carduri": 40.0, "procent": 40.0}
ALIASES = {"eximbank": "exim", "bcrlocuinte": "bcr-locuinte"}
RATE_PRODUCT = {
    "nominala": "dobanda-nominala", "marja_fixa": "dobanda-nominala", "dae": "dae", "marja_ircc": "marja-ircc", "ircc_valoare": "robor-euribor", "robor_valoare": "robor-euribor",
    "euribor_valoare": "robor-euribor", "marja_euribor": "robor-euribor", "marja_robor": "robor-euribor", "comision_procent": "comisioane", "cashback": "card-de-credit",
}
UNITS = {"LEI": "lei", "RON": "lei", "EUR": "eur", "USD": "usd"}
ROMANIA = (43.6, 48.3, 20.2, 29.8)

# A value in brackets after a margin and an index is the total, not the index.
TOTAL_IN_BRACKETS = rf"{NUMBER}\s*%\s*%?\s*\+\s*(?:IRCC|EURIBOR|ROBOR)"
# Periods and currencies in a line of rates.
PERIOD = r"(prim(?:ii|ul|ele)\s+\d+\s+(?:ani|an|luni)|pe\s+\d+\s+(?:ani|an|luni)|\d+\s+(?:ani|luni)|pe\s+toat[ăa]\s+perioada)"
CURRENCY = r"\b(lei|RON|EUR|euro|USD)\b"
# Pages that block, and shells that need scripts.
BLOCKED = r"access denied|acces blocat|request (was )?rejected|support id|incapsula|cf-chl|just a moment|attention required|captcha|/TSPD/|reference #\d"
SCRIPT_SHELL = r"id=\"(root|app|__next)\"|enable javascript"
LEAST_TEXT, BLOCKED_TEXT = 400, 1500
# Branches before machines; a partner's machines.
BRANCH, MACHINE, PARTNER = r"agenc|agenti|branch|sucursal|filial", r"\batm\b|bancomat", r"euronet|partener|parteneri|bancomat\s+partener"


# How amounts of money are written, with thousands by point, comma or space, and their currencies.
MONEY = r"[1-9]\d{0,2}(?:,\d{3})+(?:\.\d{1,2})?(?![\d,])|\d{1,3}(?:[.\s]\d{3})*(?:,\d{1,2})?|\d+(?:[.,]\d{1,2})?"
MONEY_WORD = r"(?:lei|leu|ron|euro|eur|usd|gbp|chf)"
CURRENCIES = {"lei": "LEI", "leu": "LEI", "ron": "LEI", "eur": "EUR", "euro": "EUR", "usd": "USD", "gbp": "GBP", "chf": "CHF"}
SPACED_CURRENCIES = ("LEI", "RON", "EUR", "USD")
# Bands, the interval of sums in which a fee holds. Words that name two ends come before those that name one.
# The characters ahead are those a band (a role, a frequency) begins with: everywhere else no alternative is tried.
BAND = (
    rf"(?=[\dîidbps<>≤≥])(?:(?=[\d.,\s]++(?:{MONEY_WORD}\s*+)?[–—-])(?:{MONEY})\s*{MONEY_WORD}?\s*[–—-]\s*(?:{MONEY})\s*{MONEY_WORD}"
    rf"|\b(?:[îi]ntre|de\s+la|between)\s+(?:{MONEY})\s*{MONEY_WORD}?\s*(?:[sșş]i|and|p[âa]n[ăa]\s+la|[-–—])?\s*(?:{MONEY})\s*{MONEY_WORD}"
    rf"|\b(?:peste|sub|p[âa]n[ăa]\s+(?:la|[îi]n)|[îi]ntre|de\s+la)[\s/]+(?:{MONEY})\s*{MONEY_WORD}"
    rf"|[<>≤≥]=?\s*(?:{MONEY})\s*{MONEY_WORD}?)"
)
# Words that make the figure after them a least or largest fee; how far back they are looked for.
ROLE, ROLE_REACH = r"(?=[mc])\b(min|minim|minimum|max|maxim|maximum|cel\s+pu[tț]in|cel\s+mult)\b\.?", 18
# How often a fee is due, and the words' common names.
FREQUENCY = (
    r"(?=[/latszp])(?:\b(lunar|anual|trimestrial|semestrial|zilnic|pe\s+opera[tț]iune|per\s+opera[tț]iune|la\s+fiecare)\b"
    r"|/\s*(lun[ăa]|an|zi|trimestru|semestru|opera[tț]iune|tranzac[tț]ie|card|mesaj)(?!\p{L})|\bpe\s+(lun[ăa]|an|zi|trimestru|semestru)(?!\p{L}))"
)
FREQUENCIES = {
    "luna": "lunar", "lună": "lunar", "lunar": "lunar", "an": "anual", "anual": "anual", "zi": "zilnic", "zilnic": "zilnic",
    "trimestru": "trimestrial", "trimestrial": "trimestrial", "semestru": "semestrial", "semestrial": "semestrial",
}
# Fees of nothing. "Included" counts only as a cell's own statement, not in headings or prose.
FREE = r"\bgratuit\b|f[aă]r[aă]\s+comision|nu\s+se\s+percepe"
FREE_INCLUDED = r"^[\W\d]*incluse?\b(?!.*:\s*$)|^\s*[•·▪]\S*.*\bincluse?(?:\s+[îi]n(?:\s+pachet\w*)?)?[\s.*]*$"
FREE_INCLUDED_LOWER = r"^[a-zăâîșț](?iu:[^()]*\bincluse?\s+[îi]n\s+pachet\w*[\s.*]*$)"
INCLUDED_HEADING = r"^\W*(?:produse|servicii)(?:\s+[șsş]i\s+(?:produse|servicii))?\s+incluse\b"
ZERO_IN_WORDS = r"^\W*(?:0\s*\(\s*zero\s*\)|comision\s+zero)\W*$"

# Figures that are conditions or limits, not prices.
_CLIENT = r"[îi]ncas[ăa]r\w*|rulaj|de[țt]inut\w*|de[țt]iner\w*|resurse|sold|economii|salari\w*|venit\w*"
CLIENT_CONDITION = (
    rf"(?:{_CLIENT})[^.;]{{0,30}}?\bminim\w*\b[^.;]{{0,12}}?\d|\bminim\w*\b[^.;]{{0,30}}?(?:{_CLIENT})[^.;]{{0,12}}?\d"
    rf"|(?:{_CLIENT})[^.;]{{0,40}}?(?:nu\s+)?dep[ăa][șs]e[șs]te[^.;]{{0,12}}?\d"
)
REDUCTION = r"reducer[ei][^.;]{0,30}?\d|\d\s*%[^.;]{0,15}?reducere"
COMPARISON = r"\bmai\s+(?:mic|mar[ei]|mult|pu[țt]in)\w*\s+(?:sau\s+egal\w*\s+)?(?:de|dec[âa]t|cu)\b"
FEE_LIMIT = r"\bnu\s+mai\s+(?:mic|mar[ei]|mult|pu[țt]in)"
LIMIT_LABEL = (
    r"^\s*(?:limit[ăa]|plafon|valoarea\s+maxim\w*\s+a\s+limitei|sold\s+minim|sum[ăa]\s+(?:minim|maxim)|depunere\s+ini[ţțt]ial[ăa]\s+minim"
    r"|condi[ţțt]i\w*\s+(?:de\s+)?pachet\b)"
)
REPAYMENT_LABEL = r"^\s*sum[ăa]\s+minim[ăa]\s+de\s+(?:plat|rambursa)"
BY_PERCENT, REDUCED = r"^\s*cu\s+\d+(?:[.,]\d+)?\s*%", r"\bredu[sc]"
LIMIT_WORD, WITHIN_LIMIT = r"limit[ăa]|plafon", r"\blimit[ăa]\s+(?:a|de)\s+(\d[\d.,]*)"
BAND_IN_BRACKETS, FEE_LIMIT_IN_BRACKETS = r"\b(?:sub|peste|p[âa]n[ăa]\s+la|de\s+la|[îi]ntre)\b|[<>≤≥]", r"\b(?:min|max)\w*\b"
#: A cell with fewer letters than these besides its figure and currency is only a figure.
ONLY_FIGURE = 12

# What a figure in a tariff document is about besides fees.
STATE_BUDGET = r"bugetul\s+de\s+stat"
INTEREST_WORDS, INTEREST_LABEL = r"dob[âa]nd|interest\s+(rate|on)|(?-i:\bDAE\b)|rata\s+anual", r"^\W*(?:valoarea\s+)?(?:rat|marj)\w*\s+(?:\w+\s+){0,2}dob[âa]nz"
PERCENT_A_YEAR, OVERDRAWN = r"%\s*(?:p\.\s?a\b|pe\s+an\b|/\s*an\b)", r"neautorizat|descoperit|restan[tț]|penaliz"
INDEX, INDEX_PLUS, INDEX_LABEL, ONLY_PERCENT = r"\b(?:IRCC|EURIBOR|ROBOR)\b", r"\b(?:IRCC|EURIBOR|ROBOR)\s*\+\s*\d", r"^\W*(?:valoare|indice)", r"^\s*\d+(?:[.,]\d+)?\s*%\s*$"
LIMIT_WORDS, LIMIT_SECTION, CREDIT_SUM = r"limit[ăae]\w*\s+de\s+tranzac|valoare\s+tranzac|num[ăa]r\w*\s+de\s+tranzac", r"(?:^|>)\s*\W*limit", r"^\s*sum[ăa]\s+creditului\b"
CEILING, BESIDE_CEILING = r"\bplafon", r"(?:\bsub|\bpeste|dep[ăa][șsş]\w*|acord[ăa]r\w*\s+(?:\w+\s+)?de|\bacest)\s+plafon"
LIMIT_SAID = r"limit[ăae]\w*\s+(?:zilnic|maxim|minim|lunar|cumulativ|per\s+tranzac|pe\s+tranzac)"
LIMIT_ROW = r"^\W*(?:sum[ăa]\s+per\s+tranzac|volum\w*\s+total|valoare\w*\s+maxim\w*\s+a\s+limit)"
EXCHANGE_RATE = r"curs\s+(de\s+)?schimb|curs\s+bnr|exchange\s+rate"
# Words that name no service; how many letters make capitals a title, and how many words a short heading has.
EMPTY_WORDS = ("lei", "leu", "ron", "eur", "euro", "usd", "gbp", "chf", "sau", "pentru", "din", "prin", "catre", "către", "sub", "peste", "inclusiv", "exclusiv")
CAPITAL_LETTERS, SHORT_HEADING = 6, 4

# A catalogue's figures and clauses.
CATALOGUE_NUMBER, CATALOGUE_TIMES, CATALOGUE_MONEY = r"\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?", r"(?:\s*(?:mil\.|k)(?!\p{L}))", r"(?:lei|RON|EUR|euro)\b"
SUBSCRIPTION, INTEREST, CLAUSE_END = "Abonament", r"(?:\bdob[âa]nd[ăa]\b|(?-i:\bDAE\b))", r";|\.(?=\s+[A-ZĂÂÎȘȚ]|\s*$)"
CATALOGUE_FREE = r"\b(?:gratuit\w*|f[ăa]r[ăa]\s+costuri)\b"
#: So many characters at most stand between the word for interest and its first rate, and between two rates of one list.
FIRST_LINK, NEXT_LINK = 40, 3
ACCOUNTS = ("CONT_CURENT", "CONT_OPERATIUNI")
ABOUT, AT_LEAST = "aproximativ", "valoare minimă"
# Why a figure is left unread: where to look, what to find, the reason. The first that holds counts.
UNREAD = (
    ("before", r"mpos.{0,8}$", "procent mPOS fără comision numit"),
    ("before", r"avans", "avans minim, nu dobândă"),
    ("before", r"(max\.|min\.|până la|pana la|peste|valoare)[^;,:%]{0,25}$", "limită sau prag, nu preț"),
    ("after", r"^\s*din ", "limită sau prag, nu preț"),
    ("before", r"garan.{0,15}$", "procent de garantare, nu dobândă"),
    ("after", r"^.{0,6}dob[âa]nd[ăa]\b", "dobândă la sold"),
    ("before", r"\bdob[âa]nd[ăa]\b.{0,5}$", "dobândă la sold"),
    ("after", r"^/an", "sumă anuală fără comision numit"),
    ("figure", r"[–-]|mil\.|\dk", "interval sau plafon de finanțare, nu preț"),
)
UNREAD_OTHERWISE, UNREAD_PAIR, UNREAD_FREE, UNREAD_FEE = "cifră fără serviciu numit", "două dobânzi fără variantă", "gratuitate fără sumă scrisă", "abonament la alt produs: "

# Addresses of campaigns: a cheap filter, rules and what isn't rules, paths, and words that need borders.
CAMPAIGN_FILTER = (
    "%regulament%", "%campa%", "%promo%", "%concurs%", "%oferta-special%", "%oferte-special%", "%castig%", "%premi%", "%bonus-%", "%rate-fara-dobanda%", "%tombola%", "%landing-pages/lcp-%",
)
RULES_EXCEPT = ("%plata-in-rate%", "%regulament-beneficii%")
CAMPAIGN_PATHS = (
    "%campani%", "%campaign%", "%campain%", "%promoti%", "%concurs%", "%oferta-speciala%", "%oferte-speciale%", "%premiaz%", "%rate-fara-dobanda%", "%tombola%", "%/landing-pages/lcp-%",
)
CAMPAIGN_WORDS = (r"\bpromo\b", r"castig[ai]\b", r"premii\b", r"bonus-[0-9]")

# Deposits and savings accounts: words, names in running text, what is no name.
DEPOSIT_WORDS, DEPOSIT_NAME_WORDS = "depozit|economii", 7
DEPOSIT_NAMES = (
    r"Depozit(?:ul|ele|)?\s+(?:la\s+Termen|Online|Simplu|[A-ZȚȘĂÂÎ][\wĂÂÎȚȘăâîțș]*(?:\s+[A-ZȚȘĂÂÎ0-9][\wĂÂÎȚȘăâîțș0-9+]*){0,3})",
    r"Cont(?:ul)?\s+de\s+Economii(?:\s+[A-ZȚȘĂÂÎ][\wĂÂÎȚȘăâîțș]*){0,3}",
)
BARE_DEPOSITS = ("depozit", "depozite", "depozitul", "depozitele", "cont de economii", "contul de economii")
NO_DEPOSIT_NAME = (
    "^(?:mergi la|vreau |cum |ce |de ce|care este|care sunt|detalii |aplica pentru|cat |in ce|pe ce|unde |cine |daca |prin ce|cati |cate )"
)
# Signs of a page of prices, and the words that prove it.
PRICE_SIGNS = r"tarif|comisio|taxe|lista[-_ ]?de[-_ ]?preturi|documente|informatii[-_ ]?utile|fees|pricing"
PRICE_PROOF = "comisio|tarif|taxe|pret"
# Applications: names that many banks have, categories, the market's signs.
COMMON_NAMES = ("bank", "banca", "banka", "sucursala", "romania", "internet", "grupe", "societe", "generale")
APP_GENRES, HOME_MARKET, HOME_LANGUAGE = (6015, 6000), r"(?i)(^|[^a-z])ro([^a-z]|$)|roman|rom[âa]nia", "RO"


def insensitive(rules: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    return [(label, I + pattern) for label, pattern in rules]
