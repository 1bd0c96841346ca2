"""Small word lists of the analyzer."""

#: Words too common in English prose to search for.
STOP_WORDS = frozenset("a about all also an and any are as at be been but by can could did do does for from had has have he her him his how i if in into is it its just me more most my no not of on or our she so some such than that the their them then there these they this to too was we were what when which who will with would you your".split())
#: Words too common in source code.
CODE_STOP_WORDS = frozenset("fn func function def class struct let var const return public private static void new this self import package".split())
#: Words that are never split.
WHOLE = frozenset("oauth oauth2 graphql postgresql javascript typescript github ipv4 ipv6 middleware".split())
#: Parts that compound words are divided into.
PARTS = frozenset("white list black ip error handler data base file name user time out key word end point back front code block request response client server auth log in out token parse test case config".split())
