"""Labels, word lists and patterns of French temporary traffic decrees."""

# --- fixed values: enumerations and labels ---------------------------------------------------------------------------

CATEGORIES = {
    "reseaux": "Travaux de réseaux",
    "voirie": "Travaux de voirie",
    "chantier": "Échafaudage, benne, nacelle",
    "demenagement": "Déménagement",
    "evenement": "Événement, manifestation",
    "autre": "Autre",
}
#: In order of detection.
IMPACTS = {
    "route_barree": "Route barrée",
    "circulation_alternee": "Circulation alternée ou rétrécie",
    "stationnement": "Stationnement neutralisé",
    "trottoir": "Trottoir ou cheminement piéton modifié",
    "vitesse": "Vitesse limitée",
    "deviation": "Déviation",
}
STATUSES = ("publie", "a_verifier", "masque")
QUALITIES = ("none", "approx", "street", "precise")

MONTHS = {
    "janvier": 1, "janv": 1, "fevrier": 2, "fevr": 2, "fev": 2, "mars": 3, "avril": 4, "avr": 4, "mai": 5, "juin": 6,
    "juillet": 7, "juil": 7, "aout": 8, "septembre": 9, "sept": 9, "octobre": 10, "oct": 10, "novembre": 11, "nov": 11,
    "decembre": 12, "dec": 12,
}
MONTH_NAMES = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
MONTH_SHORT = ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc.")
NUMBER_WORDS = {"un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4}

STREET_TYPES = {
    "rue": "rue", "r": "rue", "avenue": "avenue", "av": "avenue", "ave": "avenue", "chemin": "chemin", "ch": "chemin",
    "che": "chemin", "route": "route", "rte": "route", "impasse": "impasse", "imp": "impasse", "allee": "allee",
    "allees": "allee", "place": "place", "pl": "place", "boulevard": "boulevard", "bd": "boulevard", "montee": "montee",
    "square": "square", "parvis": "parvis", "passage": "passage", "cours": "cours", "quai": "quai",
    "promenade": "promenade", "sentier": "sentier", "esplanade": "esplanade", "rond": "rond",
    "lotissement": "lotissement", "clos": "clos", "residence": "residence", "voie": "voie",
}
GENERIC_PLACES = ("parking", "police municipale", "mairie", "ecole", "gymnase", "eglise")

# --- fixed values: patterns -------------------------------------------------------------------------------------------

OCR_REPAIRS = (
    (r"(\d)\s*[”\"'’]\s+(?=[a-zéû])", "$1er "),
    (r"\b1\s*er\b", "1er"),
    (r"[—–]", "-"),
    (r"[«»“”]", '"'),
    (r"[’`]", "'"),
    (r"-\n(?=[a-zé])", ""),
    ("[\\x{00A0}\\x{202F}]", " "),
)
CATEGORY_PATTERNS = {
    "demenagement": (r"demenag", 10),
    "evenement": (r"spectacle|manifestation|\bfete|foire|vide[ -]grenier|carnaval|vogue|defile|commemoration|ceremonie|\bchrono|forum|cirque|brocante|festival|concert|semaine bleue|boudin|marche de|kermesse|braderie|course|animation|exposition|feu d artifice|bal\b|repas|soiree|ducasse", 6),
    "chantier": (r"echafaudage|\bbenne|nacelle|\bgrue|livraison|dechargement|chape|toupie|ravalement|facade|toiture|elagage|demolition|camion|monte[ -]meuble|engin de levage|pompe a beton|bigbag", 5),
    "reseaux": (r"assainissement|\bgaz\b|grdf|eau potable|\baep\b|electri|enedis|\bbt\b|\bhta\b|telecom|fibre|orange|chambre|branchement|raccordement|canalisation|eclairage|reseau|conduite|\bposte\b|site radio|\btsg\b|cable|gc pour|sondage", 4),
    "voirie": (r"chaussee|enrobe|tranchee|trottoir|voirie|amenagement|ralentisseur|marquage|pave|plateau|entourage|espaces? verts?|trapeze|domaine public|bordure|signalisation horizontale", 3),
}
RESURFACING = (r"refection|reprise", r"tranchee|chaussee|enrobe|trottoir")
ROAD_CLOSED = r"circulation(?: [a-z0-9§]+){0,8}? (?:sera|est|seront|sont) interdit"
ROAD_CLOSED_TO_ALL = r"circulation (?!pietonne)(?:[a-z0-9§]+ ){0,8}?(?:sera|est|seront|sont) interdit"
FOOTPATH_CLOSED = r"circulation pietonne (sera |est )?interdit"
ROAD_CLOSED_OTHERWISE = r"route barree|acces interdit|circulation et le stationnement[^.]{0,120}interdit|stationnement et la circulation[^.]{0,120}interdit|circulation[^.]{0,30}interrompue|ferm\w+ a la circulation"
NARROWED = r"demi chaussee|alternat|chaussee retrecie|une seule voie|feux tricolores|sens unique|retreci|a la reduire|reduction de la circulation|reductions de la circulation"
PARKING = r"stationnement(?: [a-z0-9]+){0,10}? (?:sera |est |seront |sont )?(?:interdit|reserve|neutralise|genant)|places? de stationnement|stationnements? reserve|autorise\w* a stationner|stationnement (?:sera |est )?autorise|interdit\w* au stationnement|deposer une benne|reservees?"
FOOTPATH = r"pieton|trottoir"
SPEED = r"vitesse[^.]{0,40}(?:reduite|limitee)|30 kms? ?h|30 km h"

NUMBER = r"(?iu)Arr[êe]t[ée]\s+temporaire\s+N\s*[°o]?\s*:?\s*(\d{1,4})\s*/\s*(\d{2,4})"
SUBJECT = r"(?isu)Objet\s*:\s*(.+?)(?=\n\s*(?:Le\s+Maire|La\s+Pr[ée]sidente|Le\s+Pr[ée]sident|VU\b)|\n\s*\n\s*\n)"
ARTICLE = r"(?iu)(?:^|\n)\s*Article\s+(\d+|dernier|unique)\s*(?:er)?\s*[:.\-]?"
PAGE_NOISE = r"(?imu)^\s*(Page\s*:?\s*\d+|Dernière page|Police du stationnement|Police de la circulation|Extrait du registre des arrêtés.*|Arrêté de la Présidente.*|Arrêté du Président.*|de la Métropole de \w+|Métropole|#signature#)\s*$"
PERSON = r"\b(Monsieur|Madame|Mademoiselle|Mme|Mlle|Mr|M\.)\s+((?:[A-ZÀ-Ÿ][\wÀ-ÿ'’\-]+\s*){1,4})"
COMPANY = r"(?:l['’]\s*)?(?iu:entreprise|soci[ée]t[ée]|ets\.?|établissements?)\s+(?:SARL|SAS|SA\b)?\s*([A-Z0-9][A-Za-z0-9À-ÿ&'’.\- ]{1,50}?)(?=\s*(?:[,;]|domicil|\(|pour|doit|est\b|sont\b|\n|$))"
COMPANY_BARE = r"\b(?:SARL|SAS|SASU|EURL)\s+([A-Z][A-Za-z0-9À-ÿ&'’.\- ]{1,40}?)(?=\s*(?:,|domicili|\n))"
DOMICILE = r"(?iu)(domicili[ée]e?s?|demeurant|sise?)\s+(?:au\s+)?[^;\n]{0,90}?\b\d{5}\s+[A-Za-zÀ-ÿ'\- ]{2,30}"
POSTAL = r"\b\d{1,4}\s*(?:bis|ter)?,?\s+(?:rue|avenue|av\.?|chemin|route|impasse|allée|place|boulevard|bd|quai|cours)\b[^;,\n]{1,60}?[,;\s–-]+\d{5}\s+[A-Za-zÀ-ÿ'\-]+(?:\s+(?:sur|en|de|du|la|le|les|lès|d')\s*[A-Za-zÀ-ÿ'\-]+)*"
LEGAL_BOILERPLATE = r"signalisation correspondante|r\s*417|non[- ]respect|recours|charges? chacun|execution du present"
MEASURE_WORDS = r"circulation|stationn|pieton|trottoir|autoris|interdi|reserv|vitesse|chantier|itineraire|voie"

WEEKDAY = r"(?:lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche)"
NUMERIC_DATE = r"(?=\d)(?<![\d/])(\d{1,2})/(\d{1,2})(?:/(\d{4}|\d{2}))?(?![\d/])"
HOURS = r"(?iu)(?:de|entre)\s+(\d{1,2})\s*h\s*(\d{2})?\s*(?:à|a|et|jusqu'à)\s+(\d{1,2})\s*h\s*(\d{2})?"
FROM_HOUR = r"(?iu)à partir de\s+(\d{1,2})\s*(?:h|heures)\s*(\d{2})?"
DURATION = r"(?iu)dur[ée]e[^.;]{0,40}?estim[ée]e?\s+à\s+(\d+|un|une|deux|trois|quatre)\s+(jours?|semaines?|mois)"
RANGE_LINK = r"(?i)^[\s,]*(?:(?:a|à|de|des)?\s*\d{1,2}\s*(?:h|heures)\s*\d{0,2}[\s,]*)?(?:et\s+)?(?:au|jusqu)\b"
WORKS_END = r"(?iu)fin d(?:u|es) (?:défilé|travaux|manifestation)"
DECREE_NUMBER = r"(?i)^\s*AT\s*\d+\s*/\s*\d+\s*$"

# --- fixed values: thresholds -----------------------------------------------------------------------------------------

MAX_PUBLISHED_DAYS = 366
NATIVE_PAGE_CHARS, MAX_PAGES = 80, 12
PAST_DAYS, PLAUSIBLE_BEFORE, PLAUSIBLE_AFTER = 120, 400, 365 * 8
MAX_ATTEMPTS = 3
GUARD_SHARE, GUARD_LEAST, TRACKED_DAYS = 5, 5, 900
FUZZY_RATIO = 0.88
