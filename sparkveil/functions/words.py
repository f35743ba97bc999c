"""Word lists of the lexical types: named places, nationalities, religions and political groups. Countries are the members of
the United Nations and a few more, by their usual English names."""

from __future__ import annotations

LEXICON: dict[str, tuple[str, ...]] = {
    "city": (
        "amsterdam", "athens", "bangkok", "barcelona", "beijing", "berlin", "bogota", "boston", "brussels", "budapest", "cairo", "chicago", "copenhagen", "dallas", "delhi", "dublin", "geneva",
        "hamburg", "helsinki", "hong kong", "houston", "istanbul", "jakarta", "lagos", "lima", "lisbon", "london", "los angeles", "lyon", "madrid", "manila", "melbourne", "mexico city", "miami",
        "milan", "montreal", "moscow", "mumbai", "munich", "nairobi", "new york", "oslo", "paris", "prague", "rio de janeiro", "rome", "san francisco", "santiago", "seattle", "seoul", "shanghai",
        "singapore", "stockholm", "sydney", "tokyo", "toronto", "vienna", "warsaw", "washington", "zurich",
    ),
    "country": (
        "afghanistan", "albania", "algeria", "andorra", "angola", "antigua and barbuda", "argentina", "armenia", "australia", "austria", "azerbaijan", "bahamas", "bahrain", "bangladesh",
        "barbados", "belarus", "belgium", "belize", "benin", "bhutan", "bolivia", "bosnia and herzegovina", "botswana", "brazil", "brunei", "bulgaria", "burkina faso", "burundi", "cambodia",
        "cameroon", "canada", "cape verde", "central african republic", "chad", "chile", "china", "colombia", "comoros", "congo", "costa rica", "croatia", "cuba", "cyprus", "czechia",
        "czech republic", "democratic republic of the congo", "denmark", "djibouti", "dominica", "dominican republic", "ecuador", "egypt", "el salvador", "equatorial guinea", "eritrea",
        "estonia", "eswatini", "ethiopia", "fiji", "finland", "france", "gabon", "gambia", "georgia", "germany", "ghana", "greece", "grenada", "guatemala", "guinea", "guinea bissau",
        "guyana", "haiti", "honduras", "hungary", "iceland", "india", "indonesia", "iran", "iraq", "ireland", "israel", "italy", "ivory coast", "jamaica", "japan", "jordan", "kazakhstan",
        "kenya", "kiribati", "kosovo", "kuwait", "kyrgyzstan", "laos", "latvia", "lebanon", "lesotho", "liberia", "libya", "liechtenstein", "lithuania", "luxembourg", "madagascar", "malawi",
        "malaysia", "maldives", "mali", "malta", "marshall islands", "mauritania", "mauritius", "mexico", "micronesia", "moldova", "monaco", "mongolia", "montenegro", "morocco",
        "mozambique", "myanmar", "namibia", "nauru", "nepal", "netherlands", "new zealand", "nicaragua", "niger", "nigeria", "north korea", "north macedonia", "norway", "oman", "pakistan",
        "palau", "palestine", "panama", "papua new guinea", "paraguay", "peru", "philippines", "poland", "portugal", "qatar", "romania", "russia", "rwanda", "saint kitts and nevis",
        "saint lucia", "saint vincent and the grenadines", "samoa", "san marino", "sao tome and principe", "saudi arabia", "senegal", "serbia", "seychelles", "sierra leone", "singapore",
        "slovakia", "slovenia", "solomon islands", "somalia", "south africa", "south korea", "south sudan", "spain", "sri lanka", "sudan", "suriname", "sweden", "switzerland", "syria",
        "taiwan", "tajikistan", "tanzania", "thailand", "timor leste", "togo", "tonga", "trinidad and tobago", "tunisia", "turkey", "turkmenistan", "tuvalu", "uganda", "ukraine",
        "united arab emirates", "united kingdom", "united states", "united states of america", "uruguay", "uzbekistan", "vanuatu", "vatican city", "venezuela", "vietnam", "yemen", "zambia",
        "zimbabwe",
    ),
    "nationality": (
        "american", "argentine", "australian", "austrian", "belgian", "brazilian", "british", "canadian", "chilean", "chinese", "colombian", "danish", "dutch", "egyptian", "finnish", "french",
        "german", "greek", "indian", "indonesian", "irish", "israeli", "italian", "japanese", "kenyan", "korean", "mexican", "nigerian", "norwegian", "pakistani", "polish", "portuguese",
        "romanian", "russian", "spanish", "swedish", "swiss", "thai", "turkish", "ukrainian", "vietnamese",
    ),
    "religion": ("agnostic", "atheist", "baptist", "buddhist", "catholic", "christian", "hindu", "jewish", "lutheran", "methodist", "mormon", "muslim", "orthodox", "protestant", "sikh", "sunni", "shia"),
    "political": ("communist", "conservative", "democrat", "liberal", "libertarian", "republican", "socialist", "social democrat", "green party", "labour party"),
}
#: Names that are words or first names as well: only with a capital, and then with low confidence.
AMBIGUOUS = frozenset(["chile", "turkey", "china", "chad", "jordan", "georgia", "guinea", "niger", "jamaica", "washington", "paris", "lima", "orthodox", "polish", "liberal", "conservative", "democrat", "republican"])
