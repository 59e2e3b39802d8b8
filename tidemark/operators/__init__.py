"""DataFrame operations over keyed, ordered series: each takes any number of series at once."""
