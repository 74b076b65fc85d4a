"""Value rules of the categorical operators. Everything here is a fixed value."""

#: Spellings of one thing.
STANDARD_SETS = [
    ["us", "usa", "united states", "united states of america"],
    ["uk", "united kingdom", "great britain"],
    ["ae", "uae", "united arab emirates"],
    ["y", "yes", "true", "t", "1"],
    ["n", "no", "false", "f", "0"],
    ["st", "street"],
    ["rd", "road"],
    ["ave", "avenue"],
    ["apt", "apartment"],
    ["mr", "mister"],
    ["mrs", "missus"],
    ["dr", "doctor"],
    ["prof", "professor"],
]
#: Words in a column's name that tell its domain.
COUNTRY_NAME_PARTS = ["country", "nation", "location", "region", "territory"]
EMAIL_NAME_PARTS = ["email", "e-mail", "mail"]
PHONE_NAME_PARTS = ["phone", "telephone", "mobile", "cell"]
GENDER_NAME_PARTS = ["gender", "sex"]
RATING_NAME_PARTS = ["rating", "score", "rank"]
#: Short and other names of countries.
COUNTRY_ALIASES = [
    "us", "usa", "u.s.", "u.s.a.", "united states of america", "america", "the united states", "united states",
    "uk", "u.k.", "great britain", "britain", "england", "scotland", "wales", "northern ireland",
    "uae", "u.a.e.", "aus", "ca", "can", "de", "ger", "fr", "fra", "jp", "jpn", "cn", "chn", "ru", "rus", "br", "bra",
    "in", "ind", "mx", "mex", "it", "ita", "es", "esp", "kr", "kor", "za",
]
#: Names of countries.
COUNTRIES = [
    "afghanistan", "albania", "algeria", "andorra", "angola", "antigua and barbuda", "argentina", "armenia", "australia", "austria",
    "azerbaijan", "bahamas", "bahrain", "bangladesh", "barbados", "belarus", "belgium", "belize", "benin", "bhutan", "bolivia",
    "bosnia and herzegovina", "botswana", "brazil", "brunei", "bulgaria", "burkina faso", "burundi", "cabo verde", "cambodia",
    "cameroon", "canada", "central african republic", "chad", "chile", "china", "colombia", "comoros", "congo", "costa rica",
    "croatia", "cuba", "cyprus", "czechia", "czech republic", "denmark", "djibouti", "dominica", "dominican republic", "ecuador",
    "egypt", "el salvador", "equatorial guinea", "eritrea", "estonia", "eswatini", "ethiopia", "fiji", "finland", "france", "gabon",
    "gambia", "georgia", "germany", "ghana", "greece", "grenada", "guatemala", "guinea", "guinea-bissau", "guyana", "haiti",
    "honduras", "hungary", "iceland", "india", "indonesia", "iran", "iraq", "ireland", "israel", "italy", "jamaica", "japan",
    "jordan", "kazakhstan", "kenya", "kiribati", "korea", "north korea", "south korea", "kosovo", "kuwait", "kyrgyzstan", "laos",
    "latvia", "lebanon", "lesotho", "liberia", "libya", "liechtenstein", "lithuania", "luxembourg", "madagascar", "malawi",
    "malaysia", "maldives", "mali", "malta", "marshall islands", "mauritania", "mauritius", "mexico", "micronesia", "moldova",
    "monaco", "mongolia", "montenegro", "morocco", "mozambique", "myanmar", "namibia", "nauru", "nepal", "netherlands",
    "new zealand", "nicaragua", "niger", "nigeria", "north macedonia", "norway", "oman", "pakistan", "palau", "palestine", "panama",
    "papua new guinea", "paraguay", "peru", "philippines", "poland", "portugal", "qatar", "romania", "russia", "rwanda",
    "saint kitts and nevis", "saint lucia", "saint vincent and the grenadines", "samoa", "san marino", "sao tome and principe",
    "saudi arabia", "senegal", "serbia", "seychelles", "sierra leone", "singapore", "slovakia", "slovenia", "solomon islands",
    "somalia", "south africa", "south sudan", "spain", "sri lanka", "sudan", "suriname", "sweden", "switzerland", "syria", "taiwan",
    "tajikistan", "tanzania", "thailand", "timor-leste", "togo", "tonga", "trinidad and tobago", "tunisia", "turkey", "turkmenistan",
    "tuvalu", "uganda", "ukraine", "united arab emirates", "united kingdom", "united states", "uruguay", "uzbekistan", "vanuatu",
    "vatican city", "venezuela", "vietnam", "yemen", "zambia", "zimbabwe",
]
#: What is given for a country and names none.
NOT_COUNTRIES = [
    "moon", "mars", "jupiter", "saturn", "space", "universe", "international", "global", "world", "internet", "online",
    "test", "invalid", "unknown", "none", "other", "n/a",
]
EMAIL = r"(?U)^[\w.\-]+@([\w\-]+\.)+[A-Za-z]{2,}$"
#: Genders that a column may hold.
GENDERS = ["male", "female", "m", "f", "other", "non-binary", "prefer not to say"]
CATEGORY_PATTERN = r"^[A-Z]$"
#: The consistency report's rules, by a word in the column's name.
CONSISTENCY_RULES = {
    "country": {
        "valid_values": [
            "USA", "United States", "US", "Canada", "France", "Germany", "UK", "United Kingdom", "Spain", "Italy", "Japan", "China",
            "India", "Brazil", "Australia", "Morocco",
        ],
        "invalid_patterns": ["Invalid", "Unknown", "Test", "N/A"],
    },
    "rating": {"valid_range": (1, 10), "invalid_patterns": ["invalid", "none", "unknown"]},
    "category": {"valid_pattern": CATEGORY_PATTERN},
}
