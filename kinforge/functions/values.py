"""Fixed values. Word lists and constants that must equal the domain's published ones."""

# --- fixed values: months -------------------------------------------------------------
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7,
    "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

# --- fixed values: places outside the United Kingdom ----------------------------------
US_STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida",
    "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine",
    "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska",
    "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio",
    "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee",
    "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming",
)
US_STATE_CODES = (
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la",
    "me", "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok",
    "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy",
)
FOREIGN_COUNTRIES = (
    "united states", "united states of america", "usa", "us", "america", "canada", "australia", "new zealand",
    "south africa", "france", "germany", "italy", "spain", "netherlands", "belgium", "sweden", "norway",
    "denmark", "switzerland", "austria", "india", "china", "japan", "brazil", "mexico", "russia", "finland",
    "iceland", "portugal", "poland", "czech", "hungary", "romania", "nula-seleän", "tāmaki-makau-rau", "svedän",
    "sveþjóð", "suomi", "finnland", "danmark", "danmǫrk", "deutschland", "þýskaland", "frankreich", "frankrike",
    "nederland", "belgien", "schweiz", "österreich", "ísland", "irland", "italia", "españa", "espanha", "skåne",
    "uttar pradesh", "madhya pradesh", "andhra pradesh", "tamil nadu", "karnataka", "maharashtra", "gujarat",
    "rajasthan", "bihar", "west bengal", "punjab", "kerala", "odisha", "jharkhand", "assam", "himachal pradesh",
)

# --- fixed values: places inside the United Kingdom -----------------------------------
UK_WORDS = (
    "england", "wales", "scotland", "ireland", "united kingdom", "great britain", "uk", "gb", "derbyshire",
    "nottinghamshire", "yorkshire", "lancashire", "cheshire", "staffordshire", "leicestershire", "warwickshire",
    "lincolnshire", "norfolk", "suffolk", "essex", "kent", "sussex", "surrey", "hampshire", "dorset", "devon",
    "cornwall", "somerset", "wiltshire", "gloucestershire", "oxfordshire", "berkshire", "buckinghamshire",
    "hertfordshire", "bedfordshire", "cambridgeshire", "northamptonshire", "rutland", "shropshire",
    "herefordshire", "worcestershire", "middlesex", "london", "westmorland", "cumberland", "northumberland",
    "durham", "westmoreland", "monmouthshire", "birmingham", "manchester", "liverpool", "leeds", "sheffield",
    "bristol", "newcastle", "nottingham", "leicester", "derby", "coventry", "cardiff", "edinburgh", "glasgow",
    "belfast", "dublin", "bradford", "stoke", "wolverhampton", "sunderland", "portsmouth", "southampton",
    "brighton", "plymouth", "reading", "hull", "blackpool", "preston", "bolton", "sūþrīge", "heorotfordscír",
    "centlond", "bro an hañv", "oxenaford", "north hamtunscire", "stæffordscīr", "dēfnascīr", "dorseteschyre",
    "glēawceasterscīr", "èirinn a tuath", "daire",
)
# Counties read out of a place text and out of source citations, in search order.
CITED_COUNTIES = (
    "derbyshire", "nottinghamshire", "yorkshire", "lancashire", "cheshire", "staffordshire", "leicestershire",
    "warwickshire", "lincolnshire", "norfolk", "suffolk", "essex", "kent", "sussex", "surrey", "hampshire",
    "dorset", "devon", "cornwall", "somerset", "wiltshire", "gloucestershire", "oxfordshire", "berkshire",
    "buckinghamshire", "hertfordshire", "bedfordshire", "cambridgeshire", "northamptonshire", "rutland",
    "shropshire", "herefordshire", "worcestershire", "middlesex", "northumberland", "durham", "westmorland",
    "cumberland", "monmouthshire",
)
UK_COUNTRIES = (
    "england", "wales", "scotland", "ireland", "united kingdom", "great britain", "uk", "gb",
)

# --- fixed values: which county borders which -----------------------------------------
COUNTY_BORDERS = {
    "anglesey": ("caernarvonshire",),
    "bedfordshire": ("buckinghamshire", "cambridgeshire", "hertfordshire", "huntingdonshire", "northamptonshire"),
    "berkshire": (
        "buckinghamshire", "gloucestershire", "hampshire", "middlesex", "oxfordshire", "surrey", "wiltshire",
    ),
    "breconshire": ("carmarthenshire", "glamorgan", "herefordshire", "monmouthshire", "radnorshire"),
    "buckinghamshire": ("bedfordshire", "berkshire", "hertfordshire", "middlesex", "northamptonshire", "oxfordshire"),
    "caernarvonshire": ("anglesey", "denbighshire", "merionethshire"),
    "cambridgeshire": (
        "bedfordshire", "essex", "hertfordshire", "huntingdonshire", "lincolnshire", "norfolk",
        "northamptonshire", "suffolk",
    ),
    "cardiganshire": ("carmarthenshire", "merionethshire", "montgomeryshire", "pembrokeshire", "radnorshire"),
    "carmarthenshire": ("breconshire", "cardiganshire", "glamorgan", "pembrokeshire"),
    "cheshire": (
        "denbighshire", "derbyshire", "flintshire", "lancashire", "shropshire", "staffordshire", "yorkshire",
    ),
    "cornwall": ("devon",),
    "cumberland": ("durham", "lancashire", "northumberland", "scotland", "westmorland"),
    "denbighshire": ("caernarvonshire", "cheshire", "flintshire", "merionethshire", "montgomeryshire", "shropshire"),
    "derbyshire": (
        "cheshire", "leicestershire", "lincolnshire", "nottinghamshire", "staffordshire", "warwickshire",
        "yorkshire",
    ),
    "devon": ("cornwall", "dorset", "somerset"),
    "dorset": ("devon", "hampshire", "somerset", "wiltshire"),
    "durham": ("cumberland", "northumberland", "westmorland", "yorkshire"),
    "essex": ("cambridgeshire", "hertfordshire", "kent", "london", "middlesex", "suffolk", "surrey"),
    "flintshire": ("cheshire", "denbighshire", "shropshire"),
    "glamorgan": ("breconshire", "carmarthenshire", "monmouthshire"),
    "gloucestershire": (
        "berkshire", "herefordshire", "monmouthshire", "oxfordshire", "somerset", "warwickshire", "wiltshire",
        "worcestershire",
    ),
    "hampshire": ("berkshire", "dorset", "surrey", "sussex", "wiltshire"),
    "herefordshire": (
        "breconshire", "gloucestershire", "monmouthshire", "radnorshire", "shropshire", "worcestershire",
    ),
    "hertfordshire": ("bedfordshire", "buckinghamshire", "cambridgeshire", "essex", "london", "middlesex"),
    "huntingdonshire": ("bedfordshire", "cambridgeshire", "northamptonshire", "rutland"),
    "kent": ("essex", "london", "middlesex", "surrey", "sussex"),
    "lancashire": ("cheshire", "cumberland", "westmorland", "yorkshire"),
    "leicestershire": (
        "derbyshire", "lincolnshire", "northamptonshire", "nottinghamshire", "rutland", "staffordshire",
        "warwickshire",
    ),
    "lincolnshire": (
        "cambridgeshire", "derbyshire", "leicestershire", "norfolk", "northamptonshire", "nottinghamshire",
        "rutland", "yorkshire",
    ),
    "london": ("essex", "hertfordshire", "kent", "middlesex", "surrey"),
    "merionethshire": ("caernarvonshire", "cardiganshire", "denbighshire", "montgomeryshire"),
    "middlesex": ("berkshire", "buckinghamshire", "essex", "hertfordshire", "kent", "london", "surrey"),
    "monmouthshire": ("breconshire", "glamorgan", "gloucestershire", "herefordshire"),
    "montgomeryshire": ("cardiganshire", "denbighshire", "merionethshire", "radnorshire", "shropshire"),
    "norfolk": ("cambridgeshire", "lincolnshire", "suffolk"),
    "northamptonshire": (
        "bedfordshire", "buckinghamshire", "cambridgeshire", "huntingdonshire", "leicestershire",
        "lincolnshire", "oxfordshire", "rutland", "warwickshire",
    ),
    "northumberland": ("cumberland", "durham", "scotland"),
    "nottinghamshire": ("derbyshire", "leicestershire", "lincolnshire", "yorkshire"),
    "oxfordshire": (
        "berkshire", "buckinghamshire", "gloucestershire", "northamptonshire", "warwickshire", "wiltshire",
    ),
    "pembrokeshire": ("cardiganshire", "carmarthenshire"),
    "radnorshire": ("breconshire", "cardiganshire", "herefordshire", "montgomeryshire", "shropshire"),
    "rutland": ("huntingdonshire", "leicestershire", "lincolnshire", "northamptonshire"),
    "scotland": ("cumberland", "northumberland", "westmorland"),
    "shropshire": (
        "cheshire", "denbighshire", "flintshire", "herefordshire", "montgomeryshire", "radnorshire",
        "staffordshire", "worcestershire",
    ),
    "somerset": ("devon", "dorset", "gloucestershire", "wiltshire"),
    "staffordshire": ("cheshire", "derbyshire", "leicestershire", "shropshire", "warwickshire", "worcestershire"),
    "suffolk": ("cambridgeshire", "essex", "norfolk"),
    "surrey": ("berkshire", "essex", "hampshire", "kent", "london", "middlesex", "sussex"),
    "sussex": ("hampshire", "kent", "surrey"),
    "warwickshire": (
        "derbyshire", "gloucestershire", "leicestershire", "northamptonshire", "oxfordshire", "staffordshire",
        "worcestershire",
    ),
    "westmorland": ("cumberland", "durham", "lancashire", "scotland", "yorkshire"),
    "wiltshire": ("berkshire", "dorset", "gloucestershire", "hampshire", "oxfordshire", "somerset"),
    "worcestershire": ("gloucestershire", "herefordshire", "shropshire", "staffordshire", "warwickshire"),
    "yorkshire": ("cheshire", "derbyshire", "durham", "lancashire", "lincolnshire", "nottinghamshire", "westmorland"),
}

# --- fixed values: place names for a county -------------------------------------------
# Seats and short forms that stand for a county of another name.
COUNTY_ALIASES = {
    "derby": "derbyshire", "nottingham": "nottinghamshire", "lincoln": "lincolnshire",
    "leicester": "leicestershire", "stafford": "staffordshire", "warwick": "warwickshire",
    "worcester": "worcestershire", "chester": "cheshire", "lancaster": "lancashire",
    "york": "yorkshire", "northampton": "northamptonshire", "bedford": "bedfordshire",
    "cambridge": "cambridgeshire", "oxford": "oxfordshire", "gloucester": "gloucestershire",
    "hereford": "herefordshire", "huntingdon": "huntingdonshire", "salop": "shropshire",
    "berks": "berkshire", "bucks": "buckinghamshire", "cambs": "cambridgeshire",
    "derbys": "derbyshire", "glos": "gloucestershire", "hants": "hampshire",
    "herts": "hertfordshire", "hunts": "huntingdonshire", "lancs": "lancashire",
    "leics": "leicestershire", "lincs": "lincolnshire", "middx": "middlesex",
    "northants": "northamptonshire", "notts": "nottinghamshire", "oxon": "oxfordshire",
    "staffs": "staffordshire", "warks": "warwickshire", "worcs": "worcestershire",
    "wilts": "wiltshire", "yorks": "yorkshire",
}
# Towns shipped by default. A full gazetteer is the parameter ``towns``.
TOWNS = {
    "pinxton": "derbyshire", "belper": "derbyshire", "alfreton": "derbyshire",
    "chesterfield": "derbyshire", "ilkeston": "derbyshire", "ripley": "derbyshire",
    "heanor": "derbyshire", "bakewell": "derbyshire", "ashbourne": "derbyshire",
    "basford": "nottinghamshire", "burton upon trent": "staffordshire",
    "westminster": "middlesex", "kensington": "middlesex", "chelsea": "middlesex",
    "london": "middlesex", "ashford": "kent", "truro": "cornwall",
}
HISTORIC_COUNTIES = {
    "sūþrīge": "surrey", "heorotfordscír": "hertfordshire", "centlond": "kent",
    "bro an hañv": "somerset", "oxenaford": "oxfordshire",
    "north hamtunscire": "northamptonshire", "stæffordscīr": "staffordshire",
    "dēfnascīr": "devon", "dorseteschyre": "dorset", "glēawceasterscīr": "gloucestershire",
    "hamtunscir": "hampshire", "wiltunscīr": "wiltshire", "bearrucscīr": "berkshire",
    "buccingehamscīr": "buckinghamshire", "bedanfordscīr": "bedfordshire",
    "grantabrycgscīr": "cambridgeshire", "sūþsēaxe": "sussex", "ēastsēaxe": "essex",
    "norðfolc": "norfolk", "sūðfolc": "suffolk", "lǣgrecæsterscīr": "leicestershire",
    "snottingahamscīr": "nottinghamshire", "lincolnscīr": "lincolnshire",
    "ēoferwīcscīr": "yorkshire", "lancasterscīr": "lancashire", "ceasterscīr": "cheshire",
    "scrobbesbyrigscīr": "shropshire", "herefordscīr": "herefordshire",
    "wigrecæsterscīr": "worcestershire", "wealesc": "wales",
}

# --- fixed values: place words in other languages -------------------------------------
FOREIGN_PLACE_WORDS = {
    "Англи": "England", "Нэгдсэн Вант Улс": "United Kingdom",
    "Америкийн Нэгдсэн Улс": "United States", "Шотланд": "Scotland", "Уэльс": "Wales",
    "Ирланд": "Ireland", "Laustralän": "Australia", "Норвеги": "Norway", "Канад": "Canada",
    "Франц": "France", "Герман": "Germany", "Оригон": "Oregon", "Огайо": "Ohio",
    "Индиана": "Indiana", "Нью-Йорк": "New York", "Калифорни": "California",
    "Иллинойс": "Illinois", "Мичиган": "Michigan", "Техас": "Texas", "Флорида": "Florida",
    "Пенсильвани": "Pennsylvania", "Виржиниа": "Virginia", "Массачусетс": "Massachusetts",
    "Англия": "England", "Великобритания": "United Kingdom",
    "Соединённые Штаты": "United States", "Шотландия": "Scotland", "Уэлс": "Wales",
    "Ирландия": "Ireland", "Австралия": "Australia", "Канада": "Canada",
    "Норвегия": "Norway", "Франция": "France", "Германия": "Germany",
    "Èirinn a Tuath": "Northern Ireland", "Svedän": "Sweden", "Sverige": "Sweden",
}
# Old county spellings and the modern name, compared without accents.
OLD_COUNTY_SPELLINGS = {
    "deorbyscir": "Derbyshire", "beadafordscir": "Bedfordshire", "beadafordscīr": "Bedfordshire",
    "sūþseaxe": "Sussex", "hamtūnscīr": "Hampshire", "glēawecæsterscīr": "Gloucestershire",
    "oxnafordscīr": "Oxfordshire", "wiltūnscīr": "Wiltshire", "sumorsǣte": "Somerset",
    "norðfolc": "Norfolk", "sūðfolc": "Suffolk", "cent": "Kent", "defnascīr": "Devon",
    "dornsǣte": "Dorset", "hēortfordscīr": "Hertfordshire",
    "buccingahamscīr": "Buckinghamshire", "ēastseaxe": "Essex", "eoferwic": "Yorkshire",
    "eoferwicscir": "Yorkshire", "lindesig": "Lincolnshire",
    "snotingahamscir": "Nottinghamshire", "ligracesterscir": "Leicestershire",
    "scrobbesbyrigscir": "Shropshire", "wigraceasterscir": "Worcestershire",
    "warewickscir": "Warwickshire", "grantabrycgscir": "Cambridgeshire",
    "huntandunscir": "Huntingdonshire", "norþhymbra land": "Northumberland",
    "westmoringaland": "Westmorland", "bearrucscīr": "Berkshire", "bearrucscir": "Berkshire",
    "stæffordscīr": "Staffordshire", "staeffordscir": "Staffordshire", "roteland": "Rutland",
    "north hamtunscire": "Northamptonshire", "north hamtūnscīr": "Northamptonshire",
    "daire": "Londonderry", "heorotfordscír": "Hertfordshire", "heorotfordscir": "Hertfordshire",
    "dorseteschyre": "Dorset", "ratae coritanorum": "Leicestershire", "sūþrīge": "Surrey",
    "suþrige": "Surrey", "wæringscīr": "Warwickshire", "waeringscir": "Warwickshire",
    "legeceasterscir": "Cheshire", "legaceasterscir": "Cheshire", "middleseaxon": "Middlesex",
    "lancasterscir": "Lancashire", "cumberland": "Cumberland", "cornwealas": "Cornwall",
    "norðhamtūnscīr": "Northamptonshire",
}

# --- fixed values: registration districts near each other (one direction) --------------
NEARBY_DISTRICTS = {
    "derby": (
        "shardlow", "belper", "repton", "burton upon trent", "ashby de la zouch", "ashbourne", "bakewell",
        "basford", "ilkeston", "chesterfield",
    ),
    "shardlow": ("derby", "belper", "repton", "burton upon trent", "ashby de la zouch"),
    "belper": ("derby", "shardlow", "bakewell", "ashbourne", "basford", "chesterfield"),
    "repton": ("derby", "shardlow", "burton upon trent", "ashby de la zouch"),
    "burton upon trent": ("repton", "shardlow", "derby", "ashby de la zouch", "lichfield", "tamworth"),
    "ashby de la zouch": ("repton", "burton upon trent", "shardlow", "derby", "leicester"),
    "ashbourne": ("derby", "belper", "bakewell", "chapel en le frith"),
    "bakewell": ("ashbourne", "belper", "derby", "chapel en le frith", "chesterfield"),
    "basford": ("derby", "belper", "ilkeston", "nottingham", "shardlow"),
    "ilkeston": ("derby", "basford", "belper", "shardlow", "nottingham"),
    "chesterfield": ("derby", "belper", "bakewell", "basford", "worksop", "glossop"),
    "westminster": (
        "st george hanover square", "marylebone", "paddington", "kensington", "chelsea", "holborn", "pancras",
        "lambeth", "islington",
    ),
    "marylebone": (
        "westminster", "paddington", "st george hanover square", "pancras", "holborn", "islington", "hampstead",
    ),
    "kensington": ("westminster", "chelsea", "fulham", "paddington", "hammersmith", "st george hanover square"),
    "chelsea": ("kensington", "westminster", "fulham", "wandsworth"),
    "holborn": ("pancras", "islington", "marylebone", "westminster"),
    "pancras": ("holborn", "islington", "marylebone", "hampstead", "westminster"),
    "islington": ("pancras", "holborn", "hackney", "shoreditch"),
    "paddington": ("marylebone", "kensington", "westminster", "hampstead", "st george hanover square"),
    "lambeth": ("westminster", "camberwell", "wandsworth", "southwark", "newington"),
    "leicester": (
        "blaby", "billesdon", "market harborough", "hinckley", "lutterworth", "ashby de la zouch",
        "melton mowbray", "barrow upon soar",
    ),
    "nottingham": ("basford", "ilkeston", "bingham", "southwell"),
}
DISTRICT_SHORT_FORMS = {
    "ashby z.": "ashby de la zouch", "ashby z": "ashby de la zouch",
    "burton": "burton upon trent", "b. upon trent": "burton upon trent",
    "st. geo h sq": "st george hanover square", "st geo h sq": "st george hanover square",
}
QUARTERS = ("Mar", "Jun", "Sep", "Dec")

# --- fixed values: names --------------------------------------------------------------
COMMON_SURNAMES = (
    "smith", "jones", "taylor", "brown", "williams", "wilson", "johnson", "davies", "robinson", "wright",
    "thompson", "evans", "walker", "white", "roberts", "green", "hall", "wood", "jackson", "clarke", "harris",
    "clark", "turner", "hill", "scott", "cooper", "morris", "ward", "moore", "king", "watson", "baker", "allen",
    "martin", "james", "lee", "young", "lewis", "cook", "thomas", "morgan", "bell", "bennett", "edwards",
    "harrison", "hughes", "hunt", "carter", "campbell", "mitchell", "shaw", "parker", "phillips", "collins",
    "price", "kelly", "mason", "cox", "richardson", "fox", "gray", "rose", "chapman", "marshall", "simpson",
    "anderson", "adams", "reid", "stewart", "murphy", "kennedy", "watts", "holmes", "palmer", "mills", "barnes",
    "owen", "powell", "webb", "butler", "fisher", "russell", "ford", "stone", "cole", "west", "knight",
    "griffin", "murray", "barker", "harvey", "berry", "grant", "perkins", "poole", "dixon", "warren",
)
GIVEN_NAME_VARIANTS = {
    "william": ("bill", "will", "wm", "billy", "willie"),
    "elizabeth": ("betty", "bess", "liz", "eliza", "beth", "lizzie", "betsy"),
    "margaret": ("peggy", "maggie", "meg", "marge", "madge", "margie"),
    "james": ("jim", "jas", "jimmy", "jamie"),
    "robert": ("bob", "rob", "bert", "bobby", "robbie"),
    "richard": ("dick", "rick", "richie"),
    "thomas": ("tom", "thos", "tommy"),
    "henry": ("harry", "hal"),
    "edward": ("ted", "ned", "ed", "eddie", "teddy"),
    "frederick": ("fred", "freddy", "freddie"),
    "janet": ("jan", "janice", "jennet"),
    "catherine": ("kate", "kathy", "katherine", "kathryn", "kitty"),
    "john": ("jack", "jno", "johnny", "jon"),
    "charles": ("charlie", "chas", "chuck"),
    "walter": ("walt", "wally", "wat"),
    "george": ("geo",),
    "joseph": ("joe", "jos"),
    "samuel": ("sam", "saml"),
    "benjamin": ("ben", "benj"),
    "alexander": ("alex", "alec", "sandy"),
    "andrew": ("drew", "andy"),
    "dorothy": ("dot", "dolly", "dora"),
    "florence": ("flo", "flossie"),
    "mary": ("polly", "molly", "may", "mamie"),
    "sarah": ("sally", "sadie"),
    "ann": ("annie", "anna", "nan", "nancy", "anne"),
    "alice": ("ally", "allie"),
    "frances": ("fanny", "fran"),
    "helen": ("nell", "nellie", "ellen", "ella"),
    "martha": ("patty", "matty"),
    "eleanor": ("nell", "nelly", "nora"),
    "susannah": ("susan", "sue", "sukey"),
    "harriet": ("hattie", "hetty"),
    "albert": ("bert", "al"),
    "arthur": ("art",),
    "leonard": ("len", "lenny"),
    "alfred": ("alf", "alfie"),
    "ernest": ("ernie",),
    "harold": ("harry", "hal"),
    "reginald": ("reg", "reggie"),
    "ronald": ("ron", "ronnie"),
    "donald": ("don", "donnie"),
    "gerald": ("gerry", "jerry"),
    "norman": ("norm",),
    "alan": ("al", "allan", "allen"),
}
DIMINUTIVES = {
    "william": ("will", "wm", "bill", "billy"),
    "elizabeth": ("eliz", "eliza", "beth", "betty", "lizzie", "liz"),
    "margaret": ("maggie", "margt", "peggy", "meg"),
    "thomas": ("thos", "tom", "tommy"),
    "robert": ("robt", "rob", "bob", "bobby"),
    "richard": ("richd", "rich", "dick"),
    "james": ("jas", "jim", "jimmy"),
    "john": ("jno", "jack", "johnny"),
    "charles": ("chas", "charlie"),
    "edward": ("edwd", "ed", "ted", "teddy", "eddie"),
    "henry": ("harry",),
    "harry": ("henry",),
    "frederick": ("fred", "freddy", "fredk"),
    "george": ("geo",),
    "joseph": ("joe", "jos"),
    "samuel": ("sam", "saml"),
    "catherine": ("kate", "katie", "kitty", "cath"),
    "kathleen": ("kate", "katie", "kath"),
    "mary": ("maria", "marie"),
    "sarah": ("sally",),
    "ann": ("anne", "annie", "anna"),
    "dorothy": ("dot", "dolly"),
    "ethel": ("eth",),
    "florence": ("flo", "florrie"),
    "alfred": ("alf", "alfie"),
    "albert": ("bert", "bertie"),
    "herbert": ("herb", "bert", "bertie"),
    "ernest": ("ernie",),
    "arthur": ("art",),
    "joan": ("joanie",),
    "julie": ("julia",),
}
FEMALE_NAMES = (
    "mary", "jane", "elizabeth", "sarah", "ann", "alice", "emily", "emma", "charlotte", "margaret", "dorothy",
    "florence", "ethel", "edith", "ellen", "harriet", "isabella", "catherine", "agnes", "annie", "beatrice",
    "caroline", "clara", "eliza", "esther", "fanny", "frances", "gertrude", "hannah", "helen", "ida", "jessie",
    "josephine", "kate", "laura", "lilian", "lillian", "louisa", "lucy", "mabel", "maria", "martha", "matilda",
    "maud", "maude", "may", "millie", "minnie", "nellie", "olive", "phyllis", "rachel", "rosa", "rose", "ruth",
    "sophia", "susan", "violet", "winifred", "alma", "bertha", "betty", "brenda", "celia", "daisy", "daphne",
    "deborah", "diana", "doris", "dulcie", "edna", "eileen", "elsie", "enid", "evelyn", "gladys", "grace",
    "gwendoline", "hilda", "irene", "iris", "ivy", "joan", "joyce", "kathleen", "lena", "lily", "lois", "lydia",
    "maisie", "marjorie", "muriel", "nora", "norah", "pamela", "patricia", "peggy", "ruby", "sheila", "stella",
    "sylvia", "vera", "vivian", "wendy", "priscilla", "constance", "janet", "jean", "hester",
)

# --- fixed values: evidence points ------------------------------------------------------
CATEGORY_POINTS = {  # category: (points per record, most records counted)
    "Civil Registration": (15, 3),
    "Census": (12, 99),
    "Parish Register": (10, 2),
    "1939 Register": (10, 1),
    "Military": (8, 2),
    "Probate": (8, 1),
    "Other": (3, 3),
}
PRIMARY_CATEGORIES = ("Civil Registration", "Census", "1939 Register", "Parish Register")
CIVIL_FROM, CIVIL_TO = 1837, 1983


def border_pairs() -> list[tuple[str, str]]:
    return [(a, b) for a, bs in COUNTY_BORDERS.items() for b in bs]


def counties() -> list[str]:
    return list(COUNTY_BORDERS)


def gazetteer(towns: dict[str, str] | None = None) -> dict[str, str]:
    """Lower-case name to county. A county wins over a town, a town over an alias."""
    merged = {k: v for k, v in HISTORIC_COUNTIES.items()}
    merged.update(COUNTY_ALIASES)
    merged.update(TOWNS)
    merged.update(towns or {})
    merged.update({c: c for c in counties()})
    return merged


def nearby_pairs() -> list[tuple[str, str]]:
    return [(a, b) for a, bs in NEARBY_DISTRICTS.items() for b in bs]


def diminutive_pairs() -> list[tuple[str, str]]:
    once = [(a, b) for a, bs in DIMINUTIVES.items() for b in bs]
    return sorted(set(once + [(b, a) for a, b in once]))


def name_variants() -> dict[str, list[str]]:
    """Every name to the names it may be written as (both directions, one family away)."""
    reach: dict[str, set[str]] = {}
    for canonical, variants in GIVEN_NAME_VARIANTS.items():
        reach.setdefault(canonical, set()).update(variants)
        for v in variants:
            reach.setdefault(v, set()).update([canonical, *variants])
    return {k: sorted(v - {k}) for k, v in sorted(reach.items())}
