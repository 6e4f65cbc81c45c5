"""Word lists and cue phrases. Results depend on exactly these entries."""

# fixed values: marker words
AGREEMENT = (
    "yes yeah yep yup right exactly absolutely definitely agree true correct sure okay ok good great perfect fine "
    "indeed precisely totally certainly"
).split()

HEDGING = (
    "maybe perhaps possibly probably might could would kind sort somewhat fairly rather quite basically actually just "
    "like guess think believe suppose seem apparently presumably"
).split()

CERTAINTY = (
    "definitely certainly absolutely clearly obviously surely undoubtedly always never must know confident certain "
    "positive convinced guarantee fact proven"
).split()

POSITIVE = (
    "good great excellent nice wonderful fantastic amazing awesome brilliant perfect love like enjoy happy pleased "
    "glad excited interesting helpful useful agree best better benefit success successful effective efficient"
).split()

NEGATIVE = (
    "bad poor terrible awful horrible wrong problem issue difficult hard hate dislike annoying frustrating confused "
    "worried concerned doubt fail failure worse worst disagree unfortunately impossible never can't won't"
).split()

QUESTION_WORDS = "who what when where why how which whose".split()

SUGGESTION_PATTERNS = (
    r"\bwe could\b", r"\bwe should\b", r"\bwhat if\b", r"\bhow about\b", r"\bmaybe we\b", r"\bwhy don'?t we\b",
    r"\blet'?s\b", r"\bi suggest\b", r"\bi propose\b", r"\bi think we\b", r"\bwhat do you think\b",
)

# fixed values: discourse markers, single words and phrases
DISCOURSE_WORDS = {
    "elaboration": "like basically actually essentially specifically".split(),
    "contrast": "but however although though whereas yet instead".split(),
    "causal": "because so therefore since thus hence consequently".split(),
    "additive": "and also moreover besides furthermore additionally".split(),
    "temporal": "then first finally next meanwhile afterwards before".split(),
}
DISCOURSE_PHRASES = {
    "elaboration": (r"\bi mean\b", r"\byou know\b", r"\bin other words\b"),
    "contrast": (r"\bon the other hand\b", r"\bin contrast\b"),
    "causal": (r"\bas a result\b", r"\bdue to\b"),
    "additive": (r"\bin addition\b", r"\bas well\b"),
    "temporal": (r"\bat first\b", r"\bin the end\b", r"\bafter that\b"),
}

FIRST_SINGULAR = "i me my mine myself".split()
FIRST_PLURAL = "we us our ours ourselves".split()

# fixed values: dialogue-act cues, matched as substrings of the lower-cased text
ACT_CUES = {
    "statement": ("i think", "in my view", "it seems", "for me", "personally", "i believe", "from my point of view", "i feel", "in my opinion"),
    "proposal": ("we could", "how about", "what if", "let's try", "i suggest", "maybe we should", "one option is", "why don't we", "we should",
                 "i propose", "what about doing", "could we"),
    "agreement": ("exactly", "i agree", "that's right", "sounds good", "absolutely", "definitely", "totally", "i think so too", "you're right",
                  "good point", "that makes sense", "i support"),
    "disagreement": ("i don't think so", "not really", "i disagree", "i'm not sure that", "but actually", "however", "on the other hand",
                     "i would say no", "that's not", "i don't agree"),
    "compromise": ("we could combine", "maybe both", "let's mix", "meet in the middle", "compromise", "bit of both", "split the difference",
                   "middle ground", "blend", "combine both"),
    "question": ("what do you think", "should we", "do we agree", "what about", "how do we", "do you think", "would you", "can we", "shall we",
                 "don't you think", "right?", "agree?"),
    "backchannel": ("mm-hmm", "uh-huh", "mhm", "mmh", "okay", "right", "yep", "yeah", "sure", "of course", "go on", "i see"),
    "hedge": ("maybe", "i guess", "sort of", "probably", "not sure", "kind of", "i think maybe", "perhaps", "possibly", "might be", "not certain",
              "i'm not sure", "could be"),
    "decision": ("let's vote", "majority", "that's final", "shall we decide", "are we agreed", "we decided", "final decision", "we agree on",
                 "decided", "go with", "we'll go with", "we choose"),
    "offtask": ("haha", "lol", "just kidding", "by the way", "anyway", "off topic", "unrelated", "funny"),
}

# fixed values: patterns around overlaps
SUPPORT = r"\b(yeah|yep|mmh|mm-hmm|uh-huh|exactly|agree|agreed|good point|totally|absolutely|indeed)\b"
SHORT_SUPPORT = r"^(yes|right|ok|okay|sure|correct|true|definitely)[!.?,]?\s*(please|thanks|thank you)?\s*$"
CONFLICT = (
    r"\b(no|not really|i disagree|disagree|wrong|hold on|wait|stop|but|however|actually)\b",
    r"\b(let me finish|don't interrupt|you are missing)\b",
)
TRAILS_OFF = "(\\.{2,}|…|[—–]\\s*)$"
JUST_AGREES = r"^(yeah|yep|yes|mmh|mm-hmm|uh-huh|right|okay|ok|no|exactly)[.\s!]*$"
