"""English words that aren't evidence of a name."""

#: Words that begin sentences, function words and common nouns.
STOPWORDS = """
a an and are as at be because before but by for from here how i if in is it its let lets my no not now of on or our so that the their then there these they this those to
today use using we what when where which who why with you your video videos tool tools style styles folder folders file files free basic plan plans cost costs editing edit
director creative art long short form example examples think also really every day edited into will can
hold again anyways anyway all right okay ok wait well actually basically simply just like super simple trust see look yes yeah sure maybe probably literally
first second next finally anyhow alright while some full read start after plus
""".split()
#: Words that describe a product and don't identify one.
DESCRIPTORS = "ai api app agent code ide studio model models tool tools field fields frame frames server servers mcp b roll rolls the a an s".split()
#: Discourse words that are often left untranslated.
LEAK_WORDS = """
hold again anyways anyway all right alright okay ok wait well actually basically simply just like super simple trust see look yes yeah sure maybe probably literally first second
next finally cool worst best case while some full
""".split()
#: Abbreviations that may stay in Latin letters.
LATIN_TERMS = ("AI", "API", "URL", "UI", "UX", "GPU", "CPU", "RAM", "MCP", "IDE", "MD", "LLM", "ROI", "MP4", "B-roll", "B-rolls", "K-drama")
