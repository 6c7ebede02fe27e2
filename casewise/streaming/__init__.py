"""casewise.streaming"""
