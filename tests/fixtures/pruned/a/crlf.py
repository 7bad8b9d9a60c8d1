def crlf():
	return 2
