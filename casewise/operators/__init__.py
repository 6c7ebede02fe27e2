"""casewise.operators"""
