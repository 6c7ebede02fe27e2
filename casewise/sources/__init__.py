"""casewise.sources"""
