"""Built-in word lists, written for this library; all can be replaced by tables of the caller."""

#: (found, instead, not in) of terms that exclude people.
INCLUSIVE = (
    ("blacklist", "denylist", ()), ("blacklists", "denylists", ()), ("blacklisted", "denied", ()), ("whitelist", "allowlist", ()), ("whitelists", "allowlists", ()), ("whitelisted", "allowed", ()),
    ("chairman", "chair", ()), ("cripple", "weaken", ()), ("crippled", "weakened", ()), ("dummy value", "placeholder value", ()), ("grandfathered", "legacy", ()), ("guys", "everyone", ()),
    ("housekeeping", "maintenance", ()), ("man hours", "person hours", ()), ("man-hours", "person-hours", ()), ("manpower", "workforce", ()), ("mankind", "humankind", ()), ("master branch", "main branch", ()),
    ("master node", "primary node", ()), ("middleman", "intermediary", ()), ("salesman", "salesperson", ()), ("sanity check", "quick check", ()), ("sanity checks", "quick checks", ()), ("slave", "replica", ()), ("slaves", "replicas", ()),
    ("spokesman", "spokesperson", ()), ("tribal knowledge", "institutional knowledge", ()), ("webmaster", "site administrator", ()), ("workmanlike", "competent", ()),
    ("able-bodied", "non-disabled", ()), ("anchorman", "anchor", ()), ("blind spot", "gap", ()), ("brown bag lunch", "lunch talk", ()), ("businessman", "business person", ()), ("cameraman", "camera operator", ()), ("congressman", "member of congress", ()), ("craftsman", "artisan", ()),
    ("fall on deaf ears", "go unheard", ()), ("fireman", "firefighter", ()), ("foreman", "supervisor", ()), ("freshman", "first-year student", ()), ("girls", "women", ("girls school",)), ("handicapped", "disabled", ()), ("insane", "extreme", ()), ("lame", "weak", ()), ("layman's terms", "plain terms", ()), ("mailman", "mail carrier", ()),
    ("man-in-the-middle", "on-path", ()), ("man-made", "artificial", ()), ("manned", "staffed", ()), ("master/slave", "primary/replica", ()), ("native feature", "built-in feature", ()), ("normal people", "most people", ()), ("policeman", "police officer", ()), ("postman", "mail carrier", ()), ("salesmen", "salespeople", ()),
    ("sportsmanship", "fairness", ()), ("stewardess", "flight attendant", ()), ("the disabled", "disabled people", ()), ("the elderly", "older people", ()), ("tone deaf", "insensitive", ()), ("waitress", "server", ()), ("whitelisting", "allowing", ()), ("blacklisting", "denying", ()), ("white hat", "ethical", ()), ("black hat", "malicious", ()),
)
#: (found, instead, replaced automatically) of wordy phrases.
SIMPLIFY = (
    ("a majority of", "most", True), ("a number of", "several", False), ("accompany", "go with", False), ("additional", "more", False), ("as a means of", "to", False), ("at the present time", "now", True), ("at this point in time", "now", True),
    ("commence", "start", False), ("commences", "starts", False), ("despite the fact that", "although", True), ("due to the fact that", "because", True), ("endeavor", "try", False), ("facilitate", "help", False), ("facilitates", "helps", False),
    ("for the purpose of", "for", False), ("has the ability to", "can", True), ("in close proximity to", "near", True), ("in order to", "to", True), ("in spite of the fact that", "although", True), ("in the event that", "if", True),
    ("in the near future", "soon", True), ("is able to", "can", False), ("numerous", "many", False), ("on a regular basis", "regularly", True), ("prior to", "before", True), ("subsequent to", "after", True), ("subsequently", "later", False),
    ("sufficient", "enough", False), ("terminate", "end", False), ("the majority of", "most", True), ("utilise", "use", True), ("utilize", "use", True), ("utilized", "used", True), ("utilizes", "uses", True), ("utilizing", "using", True),
    ("whether or not", "whether", False), ("with regard to", "about", True), ("with respect to", "about", False), ("with the exception of", "except", True),
    ("accordingly", "so", False), ("acquire", "get", False), ("adjacent to", "next to", True), ("afford an opportunity", "let", False), ("ameliorate", "improve", False), ("apparent", "clear", False), ("as a consequence of", "because of", True), ("as of yet", "yet", True), ("ascertain", "find out", False), ("assist", "help", False),
    ("attempt to", "try to", False), ("by means of", "by", True), ("by virtue of", "by", True), ("cease", "stop", False), ("close proximity", "near", False), ("comprises", "includes", False), ("concerning", "about", False), ("consequently", "so", False), ("constitutes", "is", False), ("demonstrate", "show", False), ("designate", "name", False),
    ("discontinue", "stop", False), ("disseminate", "spread", False), ("during the course of", "during", True), ("elucidate", "explain", False), ("enumerate", "list", False), ("equitable", "fair", False), ("evident", "clear", False), ("excessive number", "too many", False), ("exhibit", "show", False), ("expedite", "speed up", False), ("expend", "spend", False),
    ("for the reason that", "because", True), ("furnish", "give", False), ("henceforth", "from now on", True), ("heretofore", "until now", True), ("if and when", "if", True), ("in accordance with", "by", False), ("in addition to", "besides", False), ("in an effort to", "to", True), ("in conjunction with", "with", True), ("in lieu of", "instead of", True),
    ("in relation to", "about", False), ("in terms of", "in", False), ("in the amount of", "for", False), ("in the course of", "during", True), ("in the process of", "while", False), ("in view of the fact that", "because", True), ("inception", "start", False), ("indicate", "show", False), ("initiate", "start", False), ("it is requested that", "please", False),
    ("magnitude", "size", False), ("methodology", "method", False), ("modify", "change", False), ("necessitate", "need", False), ("not less than", "at least", True), ("not more than", "at most", True), ("notwithstanding", "despite", False), ("obtain", "get", False), ("on the grounds that", "because", True), ("optimum", "best", False), ("permit", "let", False),
    ("pertaining to", "about", True), ("possess", "have", False), ("previously", "before", False), ("procure", "get", False), ("proficiency", "skill", False), ("purchase", "buy", False), ("remainder", "rest", False), ("remuneration", "pay", False), ("render", "make", False), ("reside", "live", False), ("retain", "keep", False), ("similar to", "like", False),
    ("solicit", "ask for", False), ("the fact that", "that", False), ("thereafter", "then", False), ("until such time as", "until", True), ("validate", "confirm", False), ("viable", "workable", False), ("with the result that", "so that", True),
)
#: canonical form: wrong forms, compared with case.
TERMINOLOGY = {
    "API": ("Api",), "CSS": ("Css",), "Docker": ("docker engine",), "GitHub": ("Github", "github", "GitHUB"), "GitLab": ("Gitlab", "gitlab"), "GraphQL": ("Graphql", "GraphQl"), "HTML": ("Html",), "HTTP": ("Http",), "HTTPS": ("Https",),
    "JavaScript": ("Javascript", "javascript", "Java Script"), "JSON": ("Json",), "Kubernetes": ("kubernetes", "Kubernates"), "Linux": ("linux",), "macOS": ("MacOS", "Mac OS", "MacOs"), "Markdown": ("markdown",), "MySQL": ("MySql", "Mysql", "mysql"),
    "Node.js": ("NodeJS", "Node.JS", "NodeJs"), "npm": ("NPM",), "OAuth": ("Oauth", "oAuth"), "PostgreSQL": ("Postgresql", "PostgreSql", "postgresql"), "Python": ("python",), "SQL": ("Sql",), "SQLite": ("SqLite", "Sqlite"), "TypeScript": ("Typescript", "typescript"),
    "URL": ("Url",), "AWS": ("Aws",), "Android": ("android",), "Apache Kafka": ("apache kafka",), "Ansible": ("ansible playbook",), "Bluetooth": ("bluetooth", "BlueTooth"), "Debian": ("debian",), "Django": ("django",), "DNS": ("Dns",), "Elasticsearch": ("ElasticSearch", "Elastic Search"), "Ethernet": ("ethernet",), "Excel": ("excel sheet",), "Firefox": ("FireFox", "firefox"), "FreeBSD": ("FreeBsd", "freebsd"), "gRPC": ("GRPC", "Grpc"),
    "IDE": ("Ide",), "iOS": ("IOS", "Ios"), "iPhone": ("Iphone", "IPhone", "iphone"), "IPv4": ("IPV4", "ipv4"), "IPv6": ("IPV6", "ipv6"), "Java": ("JAVA",), "jQuery": ("JQuery", "Jquery", "jquery"), "LaTeX": ("Latex", "LaTex"), "LinkedIn": ("Linkedin", "linkedin"), "MongoDB": ("MongoDb", "mongoDB", "mongodb"), "NumPy": ("Numpy", "numPy"), "OpenAPI": ("OpenApi", "openAPI"), "OpenSSL": ("OpenSsl", "openSSL"), "PDF": ("Pdf",),
    "PHP": ("Php",), "PowerShell": ("Powershell",), "PyTorch": ("Pytorch", "PyTorch's"), "RabbitMQ": ("RabbitMq", "rabbitMQ"), "README": ("ReadMe",), "Redis": ("redis server",), "REST API": ("Rest API", "rest API"), "SSH": ("Ssh",), "StackOverflow": ("Stackoverflow",), "SVG": ("Svg",), "TensorFlow": ("Tensorflow", "tensorFlow"), "TLS": ("Tls",), "Ubuntu": ("ubuntu",), "Unicode": ("unicode",), "Unix": ("UNIX", "unix"), "USB": ("Usb",), "UTF-8": ("utf8", "UTF8", "Utf-8"), "VS Code": ("VSCode", "VsCode", "vscode"),
    "WebAssembly": ("Web Assembly", "Webassembly"), "WebSocket": ("Websocket", "web socket"), "WordPress": ("Wordpress", "wordpress"), "XML": ("Xml",), "Wi-Fi": ("Wifi", "WiFi", "wifi"), "Windows": ("windows 11", "windows 10"), "YAML": ("Yaml",), "YouTube": ("Youtube", "youtube"),
}
#: Spellings of one word, of which a document should keep to one.
VARIANTS = (
    ("adviser", "advisor"), ("analog", "analogue"), ("ax", "axe"), ("backend", "back-end"), ("cancelled", "canceled"), ("catalog", "catalogue"), ("checkbox", "check box"), ("codebase", "code base"), ("database", "data base"), ("dataset", "data set"),
    ("dialog", "dialogue"), ("email", "e-mail"), ("filename", "file name"), ("frontend", "front-end"), ("gray", "grey"), ("homepage", "home page"), ("indexes", "indices"), ("judgement", "judgment"), ("kickoff", "kick-off"), ("labeled", "labelled"),
    ("lifecycle", "life cycle"), ("metadata", "meta-data"), ("modeling", "modelling"), ("online", "on-line"), ("plugin", "plug-in"), ("runtime", "run-time"), ("startup", "start-up"), ("timestamp", "time stamp"), ("traveled", "travelled"), ("username", "user name"),
    ("website", "web site"), ("workflow", "work flow"),
)
WEASEL = ("a lot", "basically", "clearly", "completely", "easily", "extremely", "fairly", "few", "highly", "just", "largely", "many", "mostly", "obviously", "quite", "rather", "really", "relatively", "simply", "somewhat", "surprisingly", "totally", "various", "very")
#: Phrases of formulaic writing: id, literals or pattern, kind, not followed by, instead.
PHRASES = (
    ("at-the-end-of-the-day", ("at the end of the day",), "phrase", None, ()), ("ever-evolving", ("ever-evolving", "ever-changing"), "phrase", None, ("changing",)), ("game-changer", ("game changer", "game-changer"), "phrase", None, ()),
    ("in-conclusion", ("in conclusion",), "phrase", None, ()), ("in-the-realm-of", ("in the realm of",), "phrase", None, ("in",)), ("in-todays-world", (r"in today['’]s (?:fast-paced |digital |modern )?(?:world|landscape|era)",), "pattern", None, ()),
    ("it-is-important-to-note", (r"it(?: is|['’]s) (?:important|worth|crucial) (?:to note|noting|to remember)(?: that)?",), "pattern", None, ()), ("lets-dive-in", (r"let['’]s (?:dive|delve) (?:in|into|deeper)",), "pattern", None, ()),
    ("look-no-further", ("look no further",), "phrase", None, ()), ("plays-a-crucial-role", (r"plays? an? (?:crucial|vital|pivotal|key) role(?: in)?",), "pattern", None, ()), ("stands-as-a-testament", (r"(?:stands|serves) as a testament(?: to)?",), "pattern", None, ()),
    ("take-it-to-the-next-level", ("to the next level",), "phrase", None, ()), ("tapestry-of", ("rich tapestry of", "tapestry of"), "phrase", None, ()), ("unlock-the-power", (r"unlock(?:s|ing)? the (?:full )?(?:power|potential)(?: of)?",), "pattern", None, ()),
    ("when-it-comes-to", ("when it comes to",), "phrase", None, ("for",)), ("whether-youre", (r"whether you['’]re an? \w+ or an? \w+",), "pattern", None, ()), ("without-further-ado", ("without further ado",), "phrase", None, ()),
    ("delve", ("delve", "delves", "delving"), "word", None, ("look",)), ("effortless", ("effortless", "effortlessly"), "word", None, ("easy",)), ("elevate", ("elevate", "elevates"), "word", None, ("raise",)), ("empower", ("empower", "empowers", "empowering"), "word", None, ("let",)),
    ("foster", ("foster", "fosters", "fostering"), "word", "care|parent|child|home", ("encourage",)), ("groundbreaking", ("groundbreaking",), "word", None, ("new",)), ("holistic", ("holistic",), "word", None, ("whole",)), ("leverage", ("leverage", "leverages", "leveraging"), "word", "ratio", ("use",)),
    ("meticulous", ("meticulous", "meticulously"), "word", None, ("careful",)), ("paradigm", ("paradigm",), "word", "shift register", ("model",)), ("pivotal", ("pivotal",), "word", None, ("important",)), ("robust", ("robust",), "word", "regression|statistics", ("strong",)),
    ("seamless", ("seamless", "seamlessly"), "word", None, ("smooth",)), ("synergy", ("synergy", "synergies"), "word", None, ("cooperation",)), ("transformative", ("transformative",), "word", None, ()), ("underscore", ("underscores", "underscoring"), "word", None, ("shows",)), ("vibrant", ("vibrant",), "word", None, ("lively",)),
    ("a-myriad-of", ("a myriad of", "myriad ways"), "phrase", None, ("many",)), ("a-wide-range-of", ("a wide range of", "a wide array of"), "phrase", None, ("many",)), ("as-we-navigate", (r"as we (?:navigate|move|venture) (?:through|into|forward)",), "pattern", None, ()), ("at-its-core", ("at its core", "at its heart"), "phrase", None, ()), ("beacon-of", ("beacon of",), "phrase", None, ()),
    ("best-of-both-worlds", ("best of both worlds",), "phrase", None, ()), ("bridges-the-gap", (r"bridg(?:es?|ing) the gap",), "pattern", None, ("connects",)), ("cannot-be-overstated", (r"can(?:not|['’]t) be overstated",), "pattern", None, ()), ("comes-into-play", (r"comes? into play",), "pattern", None, ("matters",)), ("cutting-edge", ("cutting-edge", "cutting edge"), "phrase", None, ("new",)),
    ("deep-dive", ("deep dive",), "phrase", None, ("close look",)), ("designed-to-empower", ("designed to empower",), "phrase", None, ()), ("embark-on", (r"embark(?:s|ing)? on (?:a|this|the|your) journey",), "pattern", None, ("start",)), ("fast-paced-world", ("fast-paced world",), "phrase", None, ()), ("first-and-foremost", ("first and foremost",), "phrase", None, ("first",)),
    ("gone-are-the-days", ("gone are the days",), "phrase", None, ()), ("harness-the-power", (r"harness(?:es|ing)? the power(?: of)?",), "pattern", None, ("use",)), ("in-a-nutshell", ("in a nutshell",), "phrase", None, ("in short",)), ("in-essence", ("in essence",), "phrase", None, ()), ("in-the-ever", (r"in (?:the|an|this) ever-\w+ (?:world|landscape|field)",), "pattern", None, ()),
    ("in-this-article", (r"in this (?:article|post|guide), we(?:['’]ll| will)",), "pattern", None, ()), ("it-goes-without-saying", ("it goes without saying",), "phrase", None, ()), ("landscape-of", (r"(?:digital|modern|current|evolving) landscape of",), "pattern", None, ("field",)), ("lets-explore", (r"let['’]s (?:explore|take a (?:closer )?look)",), "pattern", None, ()), ("look-into-the-future", ("glimpse into the future",), "phrase", None, ()),
    ("meets-the-eye", ("more than meets the eye",), "phrase", None, ()), ("navigating-the-complexities", (r"navigat(?:e|es|ing) the complexit(?:y|ies)",), "pattern", None, ()), ("needless-to-say", ("needless to say",), "phrase", None, ()), ("new-era-of", (r"(?:usher(?:s|ing)? in|marks?) a new era",), "pattern", None, ()), ("one-size-fits-all", ("one-size-fits-all", "one size fits all"), "phrase", None, ()),
    ("only-time-will-tell", ("only time will tell",), "phrase", None, ()), ("paves-the-way", (r"pav(?:es?|ing) the way(?: for)?",), "pattern", None, ()), ("picture-this", ("picture this",), "phrase", None, ()), ("power-of", ("the true power of", "the sheer power of"), "phrase", None, ()), ("push-the-boundaries", (r"push(?:es|ing)? the boundaries(?: of)?",), "pattern", None, ()), ("raises-the-bar", (r"rais(?:es?|ing) the bar",), "pattern", None, ()),
    ("reap-the-benefits", ("reap the benefits",), "phrase", None, ()), ("rest-assured", ("rest assured",), "phrase", None, ()), ("shed-light-on", (r"sheds? light on",), "pattern", None, ("explain",)), ("sheer-scale", ("the sheer scale of",), "phrase", None, ()), ("step-further", ("takes it a step further", "take it a step further"), "phrase", None, ()), ("strikes-a-balance", (r"strik(?:es?|ing) (?:a|the) (?:perfect |delicate |right )?balance",), "pattern", None, ()),
    ("sweet-spot", ("hits the sweet spot", "sweet spot between"), "phrase", None, ()), ("the-bottom-line", ("the bottom line is",), "phrase", None, ()), ("the-key-takeaway", (r"the key takeaways?(?: is| are)?",), "pattern", None, ()), ("the-possibilities", ("the possibilities are endless",), "phrase", None, ()), ("think-of-it-as", ("think of it as", "think of it like"), "phrase", None, ()), ("this-is-where", (r"this is where \w+ (?:comes? in|shines?)",), "pattern", None, ()),
    ("time-and-again", ("time and time again",), "phrase", None, ("often",)), ("to-put-it-simply", ("to put it simply", "simply put"), "phrase", None, ()), ("treasure-trove", ("treasure trove",), "phrase", None, ()), ("truly-shines", (r"(?:truly|really) shines?",), "pattern", None, ()), ("under-the-hood", ("under the hood",), "phrase", None, ("inside",)), ("up-your-game", ("up your game",), "phrase", None, ()), ("what-sets-apart", (r"what (?:truly |really )?sets \w+ apart",), "pattern", None, ()),
    ("with-that-said", ("with that said", "that being said", "having said that"), "phrase", None, ()), ("world-of", ("welcome to the world of", "enter the world of"), "phrase", None, ()), ("worth-its-salt", ("worth its salt",), "phrase", None, ()),
    ("bespoke", ("bespoke",), "word", "suit|tailor", ("custom",)), ("bolster", ("bolster", "bolsters", "bolstering"), "word", None, ("support",)), ("bustling", ("bustling",), "word", None, ("busy",)), ("captivating", ("captivating", "captivate"), "word", None, ()), ("comprehensive", ("comprehensive",), "word", "school|insurance", ("full",)), ("crucial", ("crucial", "crucially"), "word", None, ("important",)),
    ("daunting", ("daunting",), "word", None, ("hard",)), ("endeavour", ("endeavour", "endeavours", "endeavors"), "word", None, ("effort",)), ("ensuring", ("ensuring that",), "word", None, ()), ("exceptional", ("exceptional", "exceptionally"), "word", None, ()), ("harnessing", ("harnessing",), "word", "belt", ("using",)), ("innovative", ("innovative",), "word", None, ("new",)), ("intricate", ("intricate", "intricacies"), "word", None, ("detailed",)),
    ("invaluable", ("invaluable",), "word", None, ("useful",)), ("multifaceted", ("multifaceted",), "word", None, ()), ("nuanced", ("nuanced",), "word", None, ()), ("powerhouse", ("powerhouse",), "word", None, ()), ("profound", ("profound", "profoundly"), "word", None, ("deep",)), ("realm", ("realm", "realms"), "word", None, ("field",)), ("reimagine", ("reimagine", "reimagined", "reimagining"), "word", None, ()), ("resonate", ("resonate", "resonates"), "word", "frequency", ()),
    ("revolutionize", ("revolutionize", "revolutionizes", "revolutionizing", "revolutionise"), "word", None, ("change",)), ("showcase", ("showcase", "showcases", "showcasing"), "word", None, ("show",)), ("spearhead", ("spearhead", "spearheads"), "word", None, ("lead",)), ("state-of-the-art", ("state-of-the-art",), "word", None, ("new",)), ("streamline", ("streamline", "streamlines", "streamlined"), "word", None, ("simplify",)), ("supercharge", ("supercharge", "supercharges"), "word", None, ()),
    ("testament", ("testament",), "word", "of|to", ()), ("unleash", ("unleash", "unleashes"), "word", None, ()), ("unparalleled", ("unparalleled", "unmatched"), "word", None, ()), ("unwavering", ("unwavering",), "word", None, ("steady",)), ("whimsical", ("whimsical",), "word", None, ()), ("world-class", ("world-class",), "word", None, ()),
)
#: Function words by language.
FUNCTION_WORDS = {
    "en": "a an and are as at be been but by can for from had has have he her his if in is it its more not of on or she so than that the their them then there these they this to was we were what when which who will with would you".split(),
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist ja mit nach nicht noch nur oder sein sich sie sind so über um und uns unter von vor war was wie wir wird zu zum zur".split(),
    "fr": "à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur tout un une vous".split(),
    "es": "a al como con de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que qué se ser si sin sobre son su sus también un una y ya yo".split(),
    "pt": "a ao aos as com como da das de do dos e ela ele em entre era essa esse está foi há isso já mais mas me mesmo na nas não no nos o os ou para pela pelo por qual que quem se sem ser seu sua são também um uma você".split(),
    "sv": "alla att av av bara blev den det dig din du där då efter eller en ett från för genom han har hon hur här i icke inte jag kan man med men mot mycket ni när och om på sedan sig sin skulle som så till under upp ut var vi vid är".split(),
    "fi": "ei eivät en että he hän ja joka jos kuin kun me mikä minä mitä mukaan mutta myös ne niin nyt oli olla on ovat se sekä sen siellä siitä sinä tai te tämä vain vielä".split(),
}
