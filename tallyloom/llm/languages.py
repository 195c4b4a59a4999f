"""Which language a text is written in, from its function words and script."""

from __future__ import annotations

# Common function words of each language that the others do not share.
FUNCTION_WORDS = {
    "en": "the and is are was were to of that this it with for you can have has i my we they he she not but so what if when about your there here would could should will from as at in an be near went then dad see look must been their his her us our them these those no nobody nothing people who how why which before after because while give tell list write compare explain plan describe name show find make keep say know get use want need tips steps words first last day week very more most than only over up out into between each every some any both such own same other another one two three well good new",
    "de": "der die das und ist nicht ein eine einen einem einer zu mit für auf den dem des von wenn oft man sollte sonst nichts denn heute danach kommt gibt es auch nur dann etwas über bleibt wird ich sie wir ihr dafür nennt darf leider bei tut mir leid dazu kann bekommen am ende zuerst hilft bitte ruhe keine kein sich aber oder noch",
    "fr": "le la les et est une un des du pour nous avons aussi il faut car tout mais pas toujours quand devient trop on choisit ici je ne peux aider avec sur au aux ce cette ces qui que dans souvent autre enfin pendant reste plus moi impossible désolé donne merci dire ceci vous sont être",
    "es": "el los las y es una un del para tenemos también hay que mirar porque todo lo demás cuando se vuelve elegimos más aquí no me puedo ayudar con sobre al esta este estos muchas veces otra pero siempre final mientras sigue primero siento está permitido responder da por favor explica siguiente son ser",
}
#: A script that tells the language by itself.
SCRIPTS = {"zh": ("一", "鿿"), "ja": ("぀", "ヿ"), "ko": ("가", "힯"), "ru": ("Ѐ", "ӿ"), "ar": ("؀", "ۿ"), "el": ("Ͱ", "Ͽ"), "th": ("฀", "๿"), "hi": ("ऀ", "ॿ")}
