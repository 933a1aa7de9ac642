"""Word lists, patterns and tables that results depend on. All are defaults of arguments."""

# fixed values: header synonyms
HEADERS = {
    "job_title": "title", "jobtitle": "title", "company_name": "company", "employer": "company", "city": "location",
    "state_city": "location", "desc": "description", "job_description": "description", "min_salary": "min_amount",
    "max_salary": "max_amount",
}

# fixed values: core columns and their types
CORE = {
    "title": "string", "description": "string", "company": "string", "location": "string", "domain": "string",
    "min_amount": "double", "max_amount": "double", "currency": "string", "site": "string", "job_url": "string",
    "date_posted": "string",
}

# fixed values: states and country hints of locations
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
COUNTRIES = {
    "usa": "United States", "us": "United States", "united states": "United States", "u.s.": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "united kingdom": "United Kingdom", "canada": "Canada",
}

# fixed values: company suffixes, sites, title families
COMPANY_SUFFIXES = "inc incorporated llc l ltd limited corp corporation co company gmbh plc".split()
SITES = {"linkedin": "LinkedIn", "indeed": "Indeed", "glassdoor": "Glassdoor", "ziprecruiter": "ZipRecruiter", "monster": "Monster", "google jobs": "Google Jobs"}
TITLE_FAMILIES = [
    ("Data Scientist", r"\bdata scientist\b"),
    ("ML Engineer", r"\b(machine learning|ml)\s+engineer\b|\bmlops\b"),
    ("Data Engineer", r"\bdata engineer\b|\banalytics engineer\b"),
    ("Data Analyst", r"\bdata analyst\b|\bbusiness intelligence\b|\bbi analyst\b"),
    ("Research Scientist", r"\b(research|applied)\s+scientist\b|\bscientist\b"),
    ("Software Engineer", r"\bsoftware engineer\b|\b(full[- ]?stack|backend|frontend)\b.*\bengineer\b|\bdeveloper\b"),
    ("Product Manager", r"\bproduct manager\b|\bproduct owner\b"),
    ("Project / Program Manager", r"\b(project|program)\s+manager\b|\bpm\b"),
    ("Statistician", r"\bstatistician\b|\bbiostatistician\b"),
    ("Data Architect", r"\bdata architect\b"),
    ("QA / Test", r"\bqa\b|\btest(ing)?\b|\bsdet\b"),
]

# fixed values: weak-label patterns for titles and descriptions
POSITIVE_TITLES = r"""
\bscientist\b
\bassociate scientist\b
\bsenior scientist\b
\bprincipal scientist\b
\bstaff scientist\b
\bresearch scientist\b
\bresearch associate\b
\bresearch engineer\b
\bresearch analyst\b
\bpostdoctoral\b
\bpost doctoral\b
\bpost doc\b
\bpostdoctoral (research|associate|fellow|scholar)\b
\bchemist\b
\banalytical chemist\b
\borganic chemist\b
\bmedicinal chemist\b
\bmaterials (scientist|engineer)\b
\bpolymer( scientist| chemistry| chemist)\b
\bbiologist\b
\bmicrobiologist\b
\bmolecular biologist\b
\bimmunologist\b
\btoxicologist\b
\bbioengineer\b
\bbioprocess engineer\b
\bbiomedical engineer\b
\bcomputational (biolog|chemist|scientist)\b
\bdata scientist\b
\bmachine learning (scientist|engineer)\b
\bnurse\b
\bregistered nurse\b
\brn\b
\brespiratory therapist\b
\bdialysis\b
\bmedical technologist\b
\bmedical laboratory technician\b
\bmlt\b
\bhistotechnician\b
\bpathologist\b
\bsurgical technologist\b
\bpostdoc\b
\bpost[- ]?doctoral (fellow|scholar|associate)\b
\blab tech\b
\blaboratory tech\b
\blab(oratory)? technician\b
\blab(oratory)? technologist\b
\bforensic (scientist|analyst|technologist)\b
\bcrime scene (investigator|analyst|technician)\b
\bbacteriolog(ist|y)\b
\bclinical microbiolog(ist|y)\b
\bimmunolog(ist|y)\b
\btoxicolog(ist|y)\b
\bcellular (biolog(ist|y)|immunology|microbiology)\b
\bmolecular (biolog(ist|y)|geneticist|pathology)\b
\bbioinformatic(s|ian)\b
\bmetrologist\b
\bmetrology (engineer|scientist|specialist|r&d)\b
\bcytotechnolog(ist|y)\b
\bmaterials? (scientist|engineer|researcher)\b
\bmaterials? (chemistry|science)\b
\b(process|manufacturing) (engineer|scientist|chemist)\b
\bapplication(s)? analyst\b
\b(application|systems) (scientist|engineer)\b
\bchemical operator\b
\bchemical process operator\b
\bx[- ]?ray (technologist|technician|scientist)\b
\bgenomic(s)?\b
\bcytogenetic(s|ist)\b
\bbiochemist\b
\bchemical technician\b
\bchemical engineer\b
\bsynthetic biology\b
\bresearch assistant\b
\bresearch specialist\b
\bresearch technician\b
\blab assistant\b
\blaboratory manager\b
\blab( oratory)? manager\b
\blab( oratory)? supervisor\b
\bproduct development\b
\bresearch development\b
\bquality control (analyst|associate|technician|laboratory|chemistry|microbiology)\b
\bqc (analyst|chemist|chemistry|microbiology|lab)\b
\bmicrobiology specialist\b
\bvector biology\b
\bquantitative pharmacolog(?:y|ist|ists)?\b
\bpharmacometrics?\b
\bformulation development\b
\bformulation dev\b
\badvanced therap(?:y|ies)\b
\bcell therapy\b
\bbiological defense\b
\bprincipal investigator\b
\blab operations?\b
\blaboratory supervisor\b
\bmanager lab\b
research\s*&\s*development\s*(co-?op|intern(ship)?)
research and development\s*(co-?op|intern(ship)?)
\br&d\s*(co-?op|intern(ship)?)
""".strip().split("\n")
POSITIVE_DESCRIPTIONS = r"""
\bassay\b
\bassay development\b
\bchromatograph(y|ic)\b
\bHPLC\b
\bLC[- ]?MS\b
\bGC[- ]?MS\b
\bmass spec\b
\bspectroscop(y|ic)\b
\bPCR\b
\bqPCR\b
\bRT[- ]?PCR\b
\bELISA\b
\bwestern blot\b
\bSDS[- ]?PAGE\b
\bIHC\b
\bimmunohistochemistry\b
\bflow cytometry\b
\bFACS\b
\bmicroscopy\b
\bcell culture\b
\btissue culture\b
\bstem cell\b
\brna\b
\bdna\b
\bNGS\b
\bvaccine\b
\bpreclinical\b
\bmass spectrometry\b
\bsterile technique\b
\bprotein purification\b
\banalytical chemistry\b
""".strip().split("\n")
NEGATIVE_TITLES = r"""
\bcleaner\b
\bjanitor\b
\bjanitorial\b
\bcustodian\b
\bhousekeeper\b
\bhousekeeping\b
\bmaintenance\b
\bgroundskeeper\b
\bparking porter\b
\bhandyman\b
\bretail\b
\bcashier\b
\bshoprite\b
\bsales\b
\bserver\b
\bwaiter\b
\bwaitress\b
\bbarista\b
\bline cook\b
\bchef\b
\bbanquet\b
\bhotel\b
\bguest services?\b
\bteacher\b
\binstructor\b
\btutor\b
\badjunct\b
\bprofessor\b
\blecturer\b
\bschool\b
\bdriver\b
\bcourier\b
\bvalet\b
\bshuttle\b
\btransport\b
""".strip().split("\n")
# fixed values: words of title patterns that need context
CONTEXT_WORDS = ["technician", "technologist", r"tech\b", "assistant", "specialist", "supervisor", "manager", "coordinator", "analyst", "support", "associate"]
DOMAIN_ALLOWLIST = ["biology", "biotech", "biotechnology", "chemistry", "pharma", "pharmaceutical", "lab", "laboratory", "clinical"]

# fixed values: skill aliases
SKILL_ALIASES = {"excel": ["microsoft excel", "ms excel", "excel"], "power bi": ["power bi", "powerbi"], "sql": ["sql", "t-sql", "postgresql", "mysql", "sqlite"], "python": ["python"]}

# English stop words; an argument wherever they are used
STOP_WORDS = """a about above after again against all am an and any are as at be because been before being below between
both but by can could did do does doing down during each few for from further had has have having he her here hers
herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only
or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then
there these they this those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves""".split()
