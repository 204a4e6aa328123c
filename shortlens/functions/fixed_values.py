"""Word lists, tables, patterns and marks whose exact content decides the result."""

# Industry -> group of industries.
INDUSTRY_GROUPS = {
    "Furniture and Home Furnishings Manufacturing": "Manufacturing",
    "Investment Banking": "Financial and Investment",
    "Architecture and Planning": "Services",
    "Wholesale": "Services",
    "Travel Arrangements": "Services",
    "Ranching": "Miscellaneous",
    "Hospitals and Health Care": "Healthcare and Medical",
    "Book and Periodical Publishing": "Services",
    "Printing Services": "Services",
    "Professional Training and Coaching": "Services",
    "Computers and Electronics Manufacturing": "Manufacturing",
    "Shipbuilding": "Manufacturing",
    "Public Policy Offices": "Government and Public Policy",
    "Software Development": "Technology",
    "Outsourcing and Offshoring Consulting": "Services",
    "Retail Groceries": "Retail and Consumer Goods",
    "Education Administration Programs": "Education and Training",
    "Plastics Manufacturing": "Manufacturing",
    "Renewable Energy Semiconductor Manufacturing": "Manufacturing",
    "Computer Networking Products": "Technology",
    "Events Services": "Services",
    "Information Services": "Services",
    "Food and Beverage Services": "Services",
    "Semiconductor Manufacturing": "Manufacturing",
    "Business Consulting and Services": "Services",
    "Insurance": "Services",
    "Financial Services": "Services",
    "Wireless Services": "Services",
    "Computer Hardware Manufacturing": "Technology",
    "Public Safety": "Services",
    "Maritime Transportation": "Transportation and Logistics",
    "Tobacco Manufacturing": "Manufacturing",
    "Writing and Editing": "Services",
    "Veterinary Services": "Services",
    "Staffing and Recruiting": "Services",
    "Accounting": "Services",
    "International Affairs": "Government and Public Policy",
    "Spectator Sports": "Miscellaneous",
    "Glass, Ceramics and Concrete Manufacturing": "Manufacturing",
    "Chemical Manufacturing": "Manufacturing",
    "Mining": "Miscellaneous",
    "E-Learning Providers": "Technology",
    "Security and Investigations": "Services",
    "Translation and Localization": "Services",
    "Automation Machinery Manufacturing": "Technology",
    "Computer and Network Security": "Technology",
    "Political Organizations": "Government and Public Policy",
    "Environmental Services": "Government and Public Policy",
    "Oil and Gas": "Miscellaneous",
    "Real Estate": "Real Estate and Construction",
    "Think Tanks": "Government and Public Policy",
    "Executive Offices": "Miscellaneous",
    "Law Practice": "Services",
    "Nanotechnology Research": "Miscellaneous",
    "International Trade and Development": "Government and Public Policy",
    "Personal Care Product Manufacturing": "Manufacturing",
    "Philanthropic Fundraising Services": "Services",
    "Entertainment Providers": "Media and Entertainment",
    "Market Research": "Media and Entertainment",
    "Movies, Videos, and Sound": "Media and Entertainment",
    "Sporting Goods Manufacturing": "Manufacturing",
    "Graphic Design": "Services",
    "Technology, Information and Internet": "Technology",
    "IT Services and IT Consulting": "Technology",
    "Retail Office Equipment": "Retail and Consumer Goods",
    "Wholesale Import and Export": "Services",
    "Capital Markets": "Financial and Investment",
    "Law Enforcement": "Services",
    "Freight and Package Transportation": "Transportation and Logistics",
    "Industrial Machinery Manufacturing": "Manufacturing",
    "Non-profit Organizations": "Miscellaneous",
    "Retail Art Supplies": "Retail and Consumer Goods",
    "Animation and Post-production": "Media and Entertainment",
    "Transportation, Logistics, Supply Chain and Storage": "Transportation and Logistics",
    "Aviation and Aerospace Component Manufacturing": "Transportation and Logistics",
    "Fundraising": "Financial and Investment",
    "Railroad Equipment Manufacturing": "Transportation and Logistics",
    "Construction": "Real Estate and Construction",
    "Investment Management": "Financial and Investment",
    "Utilities": "Miscellaneous",
    "Retail Luxury Goods and Jewelry": "Retail and Consumer Goods",
    "Warehousing and Storage": "Transportation and Logistics",
    "Media Production": "Media and Entertainment",
    "Gambling Facilities and Casinos": "Media and Entertainment",
    "Defense and Space Manufacturing": "Manufacturing",
    "Facilities Services": "Services",
    "Government Relations Services": "Government and Public Policy",
    "Advertising Services": "Media and Entertainment",
    "Paper and Forest Product Manufacturing": "Manufacturing",
    "Packaging and Containers Manufacturing": "Manufacturing",
    "Telecommunications": "Technology",
    "Medical Equipment Manufacturing": "Healthcare and Medical",
    "Beverage Manufacturing": "Manufacturing",
    "Restaurants": "Retail and Consumer Goods",
    "Leasing Non-residential Real Estate": "Real Estate and Construction",
    "Newspaper Publishing": "Media and Entertainment",
    "Armed Forces": "Miscellaneous",
    "Appliances, Electrical, and Electronics Manufacturing": "Manufacturing",
    "Hospitality": "Services",
    "Pharmaceutical Manufacturing": "Healthcare and Medical",
    "Research Services": "Services",
    "Retail Apparel and Fashion": "Retail and Consumer Goods",
    "Photography": "Media and Entertainment",
    "Wellness and Fitness Services": "Services",
    "Truck Transportation": "Transportation and Logistics",
    "Consumer Services": "Services",
    "Wholesale Building Materials": "Services",
    "Human Resources Services": "Services",
    "Airlines and Aviation": "Transportation and Logistics",
    "Machinery Manufacturing": "Manufacturing",
    "Individual and Family Services": "Services",
    "Motor Vehicle Manufacturing": "Manufacturing",
    "Performing Arts": "Media and Entertainment",
    "Museums, Historical Sites, and Zoos": "Media and Entertainment",
    "Broadcast Media Production and Distribution": "Media and Entertainment",
    "Banking": "Financial and Investment",
    "Recreational Facilities": "Miscellaneous",
    "Government Administration": "Government and Public Policy",
    "Public Relations and Communications Services": "Media and Entertainment",
    "Fisheries": "Miscellaneous",
    "Medical Practices": "Healthcare and Medical",
    "Religious Institutions": "Miscellaneous",
    "Online Audio and Video Media": "Media and Entertainment",
    "Artists and Writers": "Miscellaneous",
    "Biotechnology Research": "Healthcare and Medical",
    "Legal Services": "Services",
    "Retail": "Retail and Consumer Goods",
    "Civil Engineering": "Services",
    "Libraries": "Miscellaneous",
    "Alternative Dispute Resolution": "Miscellaneous",
    "Manufacturing": "Miscellaneous",
    "Design Services": "Services",
    "Dairy Product Manufacturing": "Manufacturing",
    "Higher Education": "Education and Training",
    "Civic and Social Organizations": "Miscellaneous",
    "Textile Manufacturing": "Manufacturing",
    "Venture Capital and Private Equity Principals": "Financial and Investment",
    "Mental Health Care": "Healthcare and Medical",
    "Musicians": "Media and Entertainment",
    "Farming": "Miscellaneous",
    "Computer Games": "Media and Entertainment",
    "Strategic Management Services": "Services",
    "Food and Beverage Manufacturing": "Manufacturing",
    "Primary and Secondary Education": "Education and Training",
    "Alternative Medicine": "Healthcare and Medical",
    "Legislative Offices": "Services",
    "Administration of Justice": "Services",
    "Mobile Gaming Apps": "Media and Entertainment",
}

# Company sizes too small to expect openings.
SMALL_COMPANY_SIZES = ("None", "2-10 employees", "1 employee")

# Content equal to one of the words, or holding one of the phrases, says nothing.
JUNK_WORDS = ("n/a", "none", "na", " ")
JUNK_PHRASES = (
    "not mentioned",
    "not specified",
    "not provided",
    "none specified",
    "no info",
    "none provided",
    "no information provided",
    "none mentioned",
    "not available",
    "no data",
    "not explicitly stated",
    "unprovided",
)

# Topics of a parsed post -> (column, is a list).
TOPICS = {
    "Job Title and Summary": ("title_and_summary", False),
    "Company Overview": ("company_overview", False),
    "Job Responsibilities": ("responsibilities", True),
    "Qualifications and Skills": ("qualifications_and_skills", True),
    "Required Education": ("education", False),
    "Benefits and Perks": ("benefits", True),
    "Application Process": ("application", False),
    "Contact Information": ("contact_info", False),
}

# Badges on a card, in the order they are looked for.
BADGES = ("Actively Hiring", "Be an early applicant", "Medical insurance", "Paid paternity leave")

# Element classes on the pages.
WALL_CLASS = "join-form__form-body-submit-button"
BUTTON_CLASS = (
    "top-card-layout__cta mt-2 ml-1.5 h-auto babybear:flex-auto top-card-layout__cta--primary btn-md btn-primary"
)
JOB_PAGE = {
    "title": (
        "h1",
        "top-card-layout__title font-sans text-lg papabear:text-xl font-bold leading-open text-color-text mb-0 "
        "topcard__title",
    ),
    "description": (
        "div",
        "show-more-less-html__markup show-more-less-html__markup--clamp-after-5 relative overflow-hidden",
    ),
    "location": ("span", "topcard__flavor topcard__flavor--bullet"),
    "post_time": ("span", "posted-time-ago__text topcard__flavor--metadata"),
    "criteria_list": ("ul", "description__job-criteria-list"),
    "criteria_item": ("li", "description__job-criteria-item"),
    "criteria_name": ("h3", "description__job-criteria-subheader"),
    "criteria_value": ("span", "description__job-criteria-text--criteria"),
}
JOB_CARD = {
    "card": ("div", "base-card job-search-card"),
    "link": ("a", "base-card__full-link"),
    "benefits": ("span", "job-posting-benefits__text"),
    "posted": ("time", "job-search-card__listdate"),
    "company": ("a", "hidden-nested-link"),
}

# The question put to the model for each post.
PROMPT = (
    "Observe the next linkedin job post: %s\n\n\nParse the post to the next topics: Job Title and Summary (string), "
    "Company Overview (string), Job Responsibilities (list of strings), Qualifications and Skills (list of strings), "
    "Required Education (string), Benefits and Perks (list of strings), Application Process (string), "
    "Contact Information (string). In each topic write as short as possible, only the key info. If there is nothing to "
    "put in some topic, leave it empty. Topics are keys in the python dictionary, the content of the topics after parsing "
    "are the values. In Job Responsibilities, Qualifications and Skills, Required Education, Benefits and Perks - present "
    "as list of strings, very laconically and without punctuation, each string contains only one concept (e.g only one "
    "skill) Return this dictionary, without additional information, only the dictionary."
)

# Patterns of the text cleaning steps.
BRACKETED = r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}"
BLANKED_PUNCTUATION = "!\"$%&'()*-/:;<=>?[\\]^_`{|}~"
KEPT_CHARS = r"[^a-zA-Z+#/-_ ]"
WORD_SPLIT = r"\s+|,\s*"
WORD_CHARS = r"[^a-zA-Z+#/]"

# English stop words, and those kept because they name a trade.
KEPT_STOPWORDS = ("it",)
STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
    she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
    these those am is are was were be been being have has had having do does did doing a an the and but if or because as
    until while of at by for with about against between into through during before after above below to from up down in
    out on off over under again further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain
    aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
    mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)
