"""Word lists, patterns and limits that results depend on. Stated as they are, in reading order."""

# Words that mark a link or text as being about privacy, in the languages of the crawl.
PRIVACY_KEYWORDS = (
    "privacy", "privacy policy", "privacy notice", "data protection", "personal data",
    "confidentialité", "politique de confidentialité", "protection des données",
    "datenschutz", "datenschutzerklärung", "datenschutzrichtlinie",
    "privacidad", "política de privacidad", "protección de datos",
    "informativa sulla privacy", "protezione dei dati",
    "privacidade", "política de privacidade", "proteção de dados",
    "privacybeleid", "privacyverklaring",
    "integritet", "sekretess", "personuppgifter", "personvern", "personvernpolicy", "persondatapolitik",
    "polityka prywatności", "ochrona danych",
    "ochrana osobních údajů", "zásady ochrany osobných údajov",
    "politica de confidențialitate", "protecția datelor",
)
COOKIE_KEYWORDS = (
    "cookie", "cookies", "cookie policy", "cookie notice", "gestion des cookies", "politique de cookies",
    "cookies-richtlinie", "política de cookies", "politica sui cookie",
)
LEGAL_HUB_KEYWORDS = ("legal", "imprint", "impressum", "terms", "conditions", "about", "company", "mentions légales", "aviso legal", "note legali", "rechtliches")
LEGAL_HUB_URL_WORDS = ("legal", "imprint", "impressum", "terms", "about")
POLICY_HOSTERS = ("iubenda.com", "termly.io", "termsfeed.com", "privacypolicies.com", "cookiebot.com", "onetrust.com", "trustarc.com")
FALLBACK_PATHS = (
    "/privacy", "/privacy-policy", "/privacy_policy", "/privacy-notice", "/privacy_notice",
    "/legal/privacy", "/legal/privacy-policy", "/policies/privacy",
    "/datenschutz", "/datenschutzerklaerung", "/datenschutzerklärung",
    "/politique-de-confidentialite", "/politique-de-confidentialité",
    "/politica-privacidad", "/politica-de-privacidad", "/politica-privacidade",
    "/polityka-prywatnosci", "/polityka-prywatności",
    "/privacy-statement", "/gdpr", "/rgpd",
)
# URL words that raise a link's score, that lower it, and that count as a signal for links to other sites.
SCORE_URL_WORDS = ("privacy", "datenschutz", "confidential", "privacidad", "privacidade")
PENALTY_URL_WORDS = ("login", "signin", "account", "cart", "checkout")
SIGNAL_URL_WORDS = (
    "privacy", "privacy-policy", "privacy_policy", "privacy-notice", "data-protection", "data_protection",
    "gdpr", "rgpd", "datenschutz", "confidential", "privacidad", "privacidade",
)
# Terms of policy texts, and words whose presence means that a text is not about cookies alone.
POLICY_TERMS = (
    "privacy", "personal data", "data protection", "gdpr", "datenschutz", "personenbez", "confidentialit", "données",
    "privacidad", "datos personales", "protezione dei dati", "polityka prywat", "ochrona danych", "rgpd",
)
NOT_COOKIE_ONLY = ("privacy", "datenschutz", "confidential")

HREF_SKIP = ("mailto:", "tel:", "javascript:", "#")
HTML_MARKER = r"(?is)<\s*!doctype\s+html|<\s*html\b|<\s*head\b|<\s*body\b"
ERROR_PAGE_PATTERNS = (
    "access denied", "forbidden", "request blocked", "service unavailable", "temporarily unavailable", "bad gateway",
    r"error\s*404", r"404\s*not\s*found", r"\bnot found\b", "no such bucket", "nosuchbucket", "nosuchkey", "invalid url",
    "permission denied", "not authorized", "domain.*for sale", "under construction", "default web site page", "iis windows server",
)
EXCLUDED_SUFFIXES = ("gtld-servers.net", "root-servers.net", "iana-servers.net")

# Lines of policy texts: kept whatever they look like, navigation, short navigation, footer.
KEEP_KEYWORDS = ("last updated", "prior version", "definitions", "contact", "rights", "choices do i have")
NAV_KEYWORDS = (
    "sign in", "your account", "account & lists", "your lists", "cart", "returns & orders", "returns and orders", "today's deals",
    "todays deals", "prime video", "registry", "gift cards", "customer service", "search amazon", "deliver to", "all departments",
    "select the department", "back to top", "get to know us", "make money with us", "amazon payment products", "let us help you",
    "privacy preferences", "was this information helpful", "thank you for your feedback", "this information is confusing",
    "this isn't the information i was looking for", "please select what best describes", "i don't like this policy", "we're unable to respond",
)
SHORT_NAV_TOKENS = (
    "all", "en", "account", "orders", "recommendations", "browsing history", "watchlist", "cart", "registry", "create a list",
    "find a list", "content & devices", "subscribe & save items", "memberships & subscriptions", "music library",
    "find more solutions", "security and privacy", "legal policies", "submit", "yes", "no",
)
FOOTER_TOKENS = ("conditions of use", "privacy notice", "consumer health data privacy disclosure", "your ads privacy choices", "all help topics")

ONETRUST_DOMAINS = ("onetrust.com", "cookielaw.org", "cookiepro.com")
ONETRUST_HINTS = ("this privacy notice", "personal information we collect", "how we use your personal information", "your privacy rights and choices")
ONETRUST_PANEL = ("why we use cookies and other tracking technologies?", "how can you manage your preferences?", "cookie list")

KB_POLICY_KEYS = ("privacyPolicy", "privacy_policy", "privacyPolicyUrl", "privacy_policy_url", "policyUrl", "policy_url", "policy")
KB_PREVALENCE_KEYS = ("total", "overall", "prevalence", "value")
