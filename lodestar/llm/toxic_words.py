"""Common English insults, and words that address a person."""

INSULTS = (
    "idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool imbecile coward creep "
    "jerk pig rat vermin filth ugly useless hate hateful bastard bitch asshole shit fuck crap damn retard whore slut "
    "kill die shut disgrace parasite brainless"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre tú ti usted ustedes vosotros".split()
