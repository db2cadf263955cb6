"""Marked examples of the grammar rules."""


def of(language: str, *examples: str):
    return (list(examples), {"language": language})


EXAMPLES: dict = {
    "grammar/AnA": ["It is ⟦a⟧ apple and an orange.\n", "It is ⟦an⟧ boat.\n", "An hour, a unit, an HTML page, a URL, a one-off, an umbrella.\n", "This is ⟦a⟧ hour and ⟦an⟧ user.\n"],
    "grammar/RepeatedWords": ["This is ⟦the the⟧ end.\n", "They had had enough.\n", "It is `a` a boat.\n"],
    "grammar/Didnt": ["They ⟦dint⟧ go.\n", "They didn't go.\n"],
    "grammar/TheMy": ["It is ⟦the my⟧ boat.\n", "It is my boat.\n"],
    "grammar/CorrectNumberSuffix": ["The ⟦22th⟧ and ⟦11st⟧ day.\n", "The 22nd and 11th day.\n"],
    "grammar/NumberSuffixCapitalization": ["The 2⟦ND⟧ day.\n", "The 2nd day.\n"],
    "grammar/ThenThan": ["It is bigger ⟦then⟧ the boat.\n", "It is bigger than the boat.\n", "Wait, ⟦than⟧ we go.\n"],
    "grammar/PronounVerbAgreement": ["He ⟦do⟧ it.\n", "They ⟦was⟧ here.\n", "He does it and they were here.\n"],
    "grammar/SubjectVerbAgreement": ["The files ⟦is⟧ here.\n", "The file ⟦are⟧ here.\n", "The files are here.\n"],
    "grammar/YourYoure": ["I think ⟦your⟧ right.\n", "It is ⟦you're⟧ own boat.\n", "It is your boat and you're right.\n"],
    "grammar/ThereOwn": ["It is ⟦there⟧ own boat.\n", "It is their own boat.\n"],
    "grammar/ThereToTheir": ["We saw ⟦there⟧ house.\n", "We saw their house over there.\n"],
    "grammar/TheirToThere": ["⟦Their⟧ is a boat.\n", "There is a boat.\n"],
    "grammar/TheirToTheyre": ["I know ⟦their⟧ not here.\n", "I know they're not here.\n"],
    "grammar/TheyreToTheir": ["We saw ⟦they're⟧ house.\n", "We saw their house.\n"],
    "grammar/LoseLoose": ["You will ⟦loose⟧ the key.\n", "The screw is ⟦lose⟧.\n", "You will lose the loose key.\n"],
    "grammar/AffectEffect": ["It will ⟦effect⟧ the boat.\n", "It has no ⟦affect⟧ on us.\n", "It will affect us; the effect is big.\n"],
    "grammar/WhoseWhos": ["⟦Who's⟧ car is this?\n", "I ask ⟦who's⟧ house was sold.\n", "Whose car is this?\n"][1:],
    "grammar/WeatherWhether": ["We ask ⟦weather⟧ it works.\n", "The weather is fine.\n"],
    "grammar/PrincipalPrinciple": ["She is the ⟦principle⟧ engineer.\n", "It is a principle of ours.\n", "The ⟦principals⟧ of this.\n"],
    "grammar/ComplimentComplement": ["They ⟦compliment⟧ each other.\n", "A compliment is nice.\n"],
    "grammar/ItsContraction": ["I think ⟦its⟧ not here.\n", "I think its color is red.\n"],
    "grammar/ItsPossessive": ["The list and the size of ⟦it's⟧ own.\n", "It's fine.\n"],
    "grammar/WitchWhich": ["The boat, ⟦witch⟧ sank.\n", "The witch flew.\n"],
    "grammar/ExceptAccept": ["They will ⟦except⟧ the offer.\n", "All went except me.\n", "Everyone ⟦accept⟧ me went.\n"],
    "grammar/WriteRight": ["It is the ⟦write⟧ way.\n", "We write to them.\n", "Please ⟦right⟧ it down.\n"],
    "grammar/de/ArticleAgreement": of("de", "Wir sehen ⟦das⟧ Hund.\n", "Wir sehen das Haus und die Frau.\n"),
    "grammar/de/PronounVerbAgreement": of("de", "Wir ⟦ist⟧ hier.\n", "Wir sind hier und er ist da.\n"),
    "grammar/de/NounVerbAgreement": of("de", "Die Kinder ⟦geht⟧ nach Hause.\n", "Die Kinder gehen, das Kind geht.\n"),
    "grammar/de/AuxiliaryParticiple": of("de", "Er hat das Haus ⟦sehen⟧.\n", "Er hat das Haus gesehen.\n"),
    "grammar/de/SubordinateWordOrder": of("de", "Er bleibt, weil er ⟦ist krank⟧.\n", "Er bleibt, weil er krank ist.\n"),
    "grammar/de/Homophones": of("de", "Er ist ⟦seid⟧ gestern hier.\n", "Er ist seit gestern hier.\n"),
    "grammar/fr/ArticleAgreement": of("fr", "Il voit ⟦le⟧ maison.\n", "Il voit la maison et le chien.\n"),
    "grammar/fr/AdjectiveAgreement": of("fr", "La maison ⟦vert⟧ est ici.\n", "La maison verte est ici.\n"),
    "grammar/fr/PronounVerbAgreement": of("fr", "Nous ⟦est⟧ ici.\n", "Nous sommes ici.\n"),
    "grammar/fr/NounVerbAgreement": of("fr", "Les chiens ⟦est⟧ ici.\n", "Les chiens sont ici.\n"),
    "grammar/fr/AuxiliaryParticiple": of("fr", "Il a ⟦manger⟧ ici.\n", "Il a mangé ici.\n"),
    "grammar/fr/FormalSubjunctive": of("fr", "Je crois, il faut qu'il ⟦est⟧ ici.\n", "Je crois, il faut qu'il soit ici.\n"),
    "grammar/fr/PrepositionAccent": of("fr", "Elle habite ⟦a⟧ Lyon.\n", "Elle habite à Lyon.\n"),
    "grammar/fr/PrepositionContraction": of("fr", "Le toit ⟦de le⟧ garage.\n", "Le toit du garage.\n"),
    "grammar/es/ArticleAgreement": of("es", "Vemos ⟦el⟧ casa.\n", "Vemos la casa y el perro.\n"),
    "grammar/es/AdjectiveAgreement": of("es", "La casa ⟦rojo⟧ es nueva.\n", "La casa roja es nueva.\n"),
    "grammar/es/PronounVerbAgreement": of("es", "Ellos ⟦es⟧ amigos.\n", "Ellos son amigos.\n"),
    "grammar/es/NounVerbAgreement": of("es", "Los perros ⟦tiene⟧ hambre.\n", "Los perros tienen hambre.\n"),
    "grammar/es/AuxiliaryParticiple": of("es", "Ella ha ⟦hablar⟧ mucho.\n", "Ella ha hablado mucho.\n"),
    "grammar/es/ExistentialHaber": of("es", "Ayer ⟦habían⟧ muchos coches.\n", "Ayer había muchos coches.\n"),
    "grammar/es/RequiredSubjunctive": of("es", "Lo digo para que ⟦viene⟧.\n", "Lo digo para que venga.\n"),
    "grammar/es/GrammaticalAccents": of("es", "Yo no ⟦se⟧ qué es.\n", "Yo no sé qué es.\n"),
    "grammar/pt/ArticleAgreement": of("pt", "Vemos ⟦o⟧ casa.\n", "Vemos a casa e o carro.\n"),
    "grammar/pt/AdjectiveAgreement": of("pt", "A casa ⟦novo⟧ fica aqui.\n", "A casa nova fica aqui.\n"),
    "grammar/pt/PronounVerbAgreement": of("pt", "Eles ⟦tem⟧ um carro.\n", "Eles têm um carro.\n"),
    "grammar/pt/NounVerbAgreement": of("pt", "Os meninos ⟦fala⟧ muito.\n", "Os meninos falam muito.\n"),
    "grammar/pt/ModalInfinitive": of("pt", "Hoje posso ⟦falo⟧ aqui.\n", "Hoje posso falar aqui.\n"),
    "grammar/pt/ExistentialHaver": of("pt", "Ontem ⟦haviam⟧ muitos carros.\n", "Ontem havia muitos carros.\n"),
    "grammar/pt/RequiredSubjunctive": of("pt", "Digo para que ele ⟦vem⟧.\n", "Digo para que ele venha.\n"),
    "grammar/pt/CopulaAccents": of("pt", "Acho que ela ⟦e⟧ muito boa.\n", "Acho que ela é muito boa.\n"),
    "grammar/pt/MissingCrase": of("pt", "Hoje vou ⟦a⟧ escola.\n", "Hoje vou à escola.\n"),
    "grammar/sv/ArticleGender": of("sv", "Vi såg ⟦en⟧ hus.\n", "Vi såg ett hus och en bil.\n"),
    "grammar/sv/AdjectiveGender": of("sv", "Vi köpte ett ⟦röd⟧ bord.\n", "Vi köpte ett rött bord.\n"),
    "grammar/sv/CompoundSplit": of("sv", "Vi var på ett ⟦sjuk hus⟧.\n", "Vi var på ett sjukhus.\n"),
    "grammar/sv/Capitalization": of("sv", "Vi ses på ⟦Måndag⟧.\n", "Vi ses på måndag.\n"),
    "grammar/sv/SentenceStart": of("sv", "Vi ses. ⟦det⟧ är bra.\n", "Vi ses. Det är bra.\n"),
    "grammar/sv/DomDem": of("sv", "Jag vet, ⟦dem⟧ är här.\n", "Jag vet, de är här.\n"),
    "grammar/sv/DeDem": of("sv", "Jag vet att ⟦dem⟧ är här.\n", "Jag vet att de är här.\n"),
    "grammar/sv/PresentTense": of("sv", "Nu jag ⟦prata⟧ mycket.\n", "Nu pratar jag mycket.\n"),
    "grammar/sv/Supine": of("sv", "Han har ⟦skriven⟧ det.\n", "Han har skrivit det.\n"),
    "grammar/sv/AttInfinitive": of("sv", "Han tycker om att ⟦läser⟧.\n", "Han tycker om att läsa.\n"),
    "grammar/fi/CompoundSplit": of("fi", "Tuo on ⟦auto talli⟧.\n", "Tuo on autotalli.\n"),
    "grammar/fi/CompoundJoined": of("fi", "Tule ⟦ennenkuin⟧ menen.\n", "Tule ennen kuin menen.\n"),
    "grammar/fi/Capitalization": of("fi", "Tulen taas ⟦Maanantaina⟧.\n", "Tulen taas maanantaina.\n"),
    "grammar/fi/SentenceStart": of("fi", "Tulen. ⟦hän⟧ menee.\n", "Tulen. Hän menee.\n"),
    "grammar/fi/Kuin": of("fi", "Se on parempi ⟦kun⟧ tuo.\n", "Se on parempi kuin tuo.\n"),
    "grammar/fi/Comma": of("fi", "Luulen⟦ ⟧että hän tulee.\n", "Luulen, että hän tulee.\n"),
    "grammar/fi/VaanVain": of("fi", "Tuo ei ole kissa ⟦vain⟧ koira.\n", "Tuo ei ole kissa vaan koira.\n"),
    "grammar/fi/Agreement": of("fi", "Nyt minä ⟦olet⟧ kotona.\n", "Nyt minä olen kotona.\n"),
    "grammar/fi/Elative": of("fi", "Minä pidän ⟦kahvi⟧.\n", "Minä pidän kahvista.\n"),
    "grammar/fi/Illative": of("fi", "Nyt menen ⟦koulussa⟧.\n", "Nyt menen kouluun.\n"),
    "grammar/fi/Relative": of("fi", "Tuo on kaikki, ⟦joka⟧ jäi.\n", "Tuo on kaikki, mikä jäi.\n"),
}
