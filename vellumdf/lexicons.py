"""Word lists and abbreviations of the text metrics."""

from __future__ import annotations

# Stop words.
STOP = {
    "de": (
        "der die das den dem des ein eine einer einem einen eines und oder aber als auch an am auf aus bei bis durch für gegen im in ins mit nach ohne um über unter vom von vor zum zur zu ist sind war waren wird werden wurde wurden sein seine sich es er sie ihr ihre ich du wir ihr sie mein meine nicht noch nur so da dann denn wenn weil dass wie was wer wo schon sehr hat haben hatte hatten kann können könnte muss doch man mich mir dich dir uns euch dieser diese dieses einem einer alle mehr als "
        "ihn ihm ihnen ihrer ihrem ihren ihres unserer unserem unseren euer eure euren dessen deren dies solche solch würde würden konnte konnten sollte sollten hatte hätte hätten ihm man ja nein auch"
    ).split(),
    "en": "a an the and or but as at by for from in into of on onto to with without is are was were be been being am he she it they we you i me him her them us my your his its our their this that these those there here not no so if when while because which who what where how can could may might must will would shall should do does did have has had than then also just very only some all any each".split(),
}

# Marker words of the style and cohesion metrics.
LEXICONS = {
    "fillers": {"de": "eigentlich irgendwie gewissermaßen sozusagen halt eben quasi praktisch regelrecht letztendlich", "en": "actually basically essentially literally anyway anyhow somehow just really"},
    "hedges": {"de": "vielleicht möglicherweise vermutlich wahrscheinlich offenbar anscheinend scheinbar eventuell wohl womöglich", "en": "perhaps possibly probably apparently seemingly presumably maybe arguably"},
    "intensifiers": {"de": "sehr äußerst extrem völlig total absolut unglaublich wirklich besonders überaus ungemein", "en": "very extremely totally absolutely incredibly truly utterly quite deeply highly"},
    "connectors": {"de": "deshalb deswegen daher dennoch jedoch trotzdem außerdem zudem folglich während hingegen somit weil obwohl damit schließlich", "en": "therefore however moreover nevertheless nonetheless furthermore consequently whereas although because hence thus meanwhile"},
    "firstPerson": {"de": "ich mich mir mein meine meiner meinem meinen meines wir uns unser unsere unserer unserem unseren unseres", "en": "i me my mine myself we us our ours ourselves"},
    "negations": {"de": "nicht nie niemals niemand niemanden nichts kein keine keiner keinem keinen keines weder", "en": "not no never nobody nothing neither nowhere cannot can't don't doesn't didn't isn't aren't wasn't weren't won't wouldn't shouldn't couldn't"},
    "sensory": {"de": "sehen sah blick blickte glanz schimmer licht dunkel hell hören hörte klang rauschen knistern roch riechen duft geruch schmecken geschmack süß bitter salzig kalt warm rau weich berühren berührte", "en": "see saw gaze glanced glow glimmer light dark bright hear heard sound rustle whisper smell smelled scent taste sweet bitter salty cold warm rough soft touch touched"},
    "cognition": {"de": "denken dachte denkt wissen wusste weiß fühlen fühlte fühlt glauben glaubte glaubt hoffen hoffte erinnert erinnerte erinnerung angst freude trauer zweifel", "en": "think thought thinks know knew knows feel felt feels believe believed believes hope hoped remember remembered memory fear joy grief doubt"},
}

# Abbreviations after which a point ends no sentence.
ABBREVIATIONS = "dr prof mr mrs ms st nr bzw ca usw z b u a d h e g i vgl abb evtl etc vs inc jr sr jan feb mar apr jun jul aug sep sept oct okt nov dec dez".split()

# Auxiliaries of the passive, and participles its endings miss.
PASSIVE_AUXILIARIES = {"de": "wird werden wurde wurden werde wirst werdet worden".split(), "en": "be been being is are was were am".split()}
PARTICIPLES_EN = "made built found told seen done said sent bought".split()

# Endings of abstract nouns.
NOMINAL = {"de": "(?:ung|heit|keit|ismus|ität|schaft)(?:en|e|s)?$", "en": "(?:tion|sion|ment|ness|ity|ism)s?$"}
